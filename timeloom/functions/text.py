"""Text predicates and measures as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\s　]"


def strip(text: Column) -> Column:
    """Without leading and trailing white space, the ideographic space included."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def compact(text: Column) -> Column:
    """Without white space and sentence marks: the key under which texts count as equal."""
    return F.regexp_replace(text, "[\\s　、。,.，．!！?？]", "")


#: White space of all scripts, sentence marks, quotes and brackets: what does not count when whole texts are compared.
COMPARE_DROP = "[\\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000,.;:!?！？、。・ー~〜…'\"“”‘’「」『』（）()]+"


def compare_key(text: Column) -> Column:
    """The whole text in small letters without COMPARE_DROP; empty for a null text."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COMPARE_DROP, ""))


def density(text: Column, seconds: Column) -> Column:
    """Stripped characters per second; durations below a millisecond count as one."""
    return F.length(strip(text)) / F.greatest(F.lit(0.001), seconds)


def share(text: Column, chars: str, ignored: str = "\\s\\d") -> Column:
    """Share of the characters in class ``chars`` among those not in class ``ignored``; 0 for none."""
    kept = F.regexp_replace(text, f"[{ignored}]", "")
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(kept, f"[^{chars}]", "")), F.length(kept)), F.lit(0.0))


def speech_chars(text: Column) -> Column:
    """Letters and numbers of any script."""
    return F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]", ""))


def longest_run(text: Column) -> Column:
    """Length of the longest run of one character."""
    runs = F.regexp_extract_all(text, F.lit("(?s)((.)\\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def dominant_run(text: Column, least: int = 25, cover: float = 0.55, rest: int = 16) -> Column:
    """A run of at least ``least`` equal characters that covers ``cover`` of the text or leaves at most ``rest`` of it."""
    run, n = longest_run(text), F.length(text)
    return (run >= least) & ((run >= cover * n) | (n - run <= rest))


def replace_all(text: Column, pairs: list[tuple[str, str]], passes: int = 3) -> Column:
    """Ordered replacements, at most ``passes`` times over; a pass that changes nothing is the identity."""
    for _ in range(passes):
        text = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
    return text


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a literal that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def numbers(text: Column) -> Column:
    """All runs of digits, as numbers of up to 38 digits; longer ones are null."""
    return F.transform(F.regexp_extract_all(text, F.lit("(\\d+)"), F.lit(1)), lambda x: x.try_cast("decimal(38,0)"))


def confidence(value: Column) -> Column:
    """A confidence from loose text: word labels, or the first number (a percentage if marked so or above 1), within 0 and 1; null if none."""
    v = F.lower(F.trim(value))
    word = F.when(v.isin("true", "yes"), 1.0).when(v.isin("false", "no"), 0.0).when(v == "high", 0.9).when(v == "medium", 0.6).when(v == "low", 0.3)
    found = F.regexp_extract(v, "(-?\\d+(?:\\.\\d+)?)", 1)
    number = F.when(found != "", found.cast("double"))
    scaled = F.when(v.contains("%") | (number > 1), number / 100).otherwise(number)
    return F.coalesce(word.cast("double"), F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))))


def safe_id(value: Column) -> Column:
    """Whether a string is usable as a file name: trimmed, not empty, no separators or NUL, not ``.`` or ``..``."""
    return F.coalesce((value == F.trim(value)) & (value != "") & ~F.regexp_like(value, F.lit("[/\\\\\\x00]")) & ~value.isin(".", ".."), F.lit(False))


def natural_key(value: Column) -> Column:
    """A sort key under which digit runs compare as numbers, of any length: each is led by its number of digits."""
    parts = F.regexp_extract_all(value, F.lit("(\\d+|\\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=\\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit("^\\d")), F.concat(F.format_string("%08d", F.length(digits(p))), digits(p))).otherwise(F.lower(p))), "")


def pause_seconds(text: Column, default: float) -> Column:
    """Seconds from forms like ``1.5s``, ``800ms`` or ``2 sec``; else the default."""
    low = F.lower(text)
    ms, sec = F.regexp_extract(low, "(\\d+(?:\\.\\d+)?)\\s*ms", 1), F.regexp_extract(low, "(\\d+(?:\\.\\d+)?)\\s*(?:s\\b|sec|秒)", 1)
    return F.when(ms != "", F.try_to_number(ms, F.lit("999999.999")).cast("double") / 1000).when(sec != "", F.try_to_number(sec, F.lit("999999.999")).cast("double")).otherwise(F.lit(default))


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """An ordered chain of regular expressions."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def pronunciation_count(text: Column) -> Column:
    """Beats of a Japanese text: small kana none, other kana, stops, long marks, letters and digits one, ideographs two."""
    spoken = F.length(F.regexp_replace(F.regexp_replace(text, "[^\\p{L}\\p{N}ー]", ""), "[ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ]", ""))
    return spoken + F.length(F.regexp_replace(text, "[^㐀-䶿一-鿿豈-﫿]", ""))


def safe_name(value: Column) -> Column:
    """Usable in a file name: other characters become single underscores; ``unnamed`` if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(value, "[^\\p{L}\\p{N}._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(t == "", "unnamed").otherwise(t)
