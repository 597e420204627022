"""Numbers counted aloud: reading them from Japanese and Korean text, repairing countdowns, and planning how they are spoken. All are column expressions.

Values are 0 to 99. A null text gives null or no values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeloom.functions.numeric import is_countdown, steps
from timeloom.functions.spoken import DIGITS, let, look_up, replaced

# Korean native numerals, and readings of Japanese ones.
NATIVE_ONES = ["영", "하나", "둘", "셋", "넷", "다섯", "여섯", "일곱", "여덟", "아홉"]
NATIVE_TENS = ["", "열", "스물", "서른", "마흔", "쉰", "예순", "일흔", "여든", "아흔"]
KANJI = "一二三四五六七八九"
KANA = [("いち", 1), ("に", 2), ("さん", 3), ("よん", 4), ("し", 4), ("ご", 5), ("ろく", 6), ("なな", 7), ("しち", 7), ("はち", 8), ("きゅう", 9), ("く", 9)]
ZERO = ["ゼロ", "ぜろ", "れい", "レイ", "零", "〇"]
FILLER = "^\\s*말이에요[.!?。！？]*\\s*$"
SEPARATORS = "\\s,，、.!?。！？・:：;；/\\\\\\-~〜"


def hiragana(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097))))


def plain(text: Column) -> Column:
    """Full-width digits and marks in their common form, trimmed; runs of dots as one mark."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.regexp_replace(F.trim(F.translate(text, wide + "　", "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ")), "\\.{2,}", "…")


def source_tokens() -> dict[str, str]:
    """Every spelling of 0 to 99 but plain digits, in hiragana where there is a choice."""
    out = {z: "0" for z in ZERO} | {k: str(v) for k, v in KANA} | {"じゅう": "10"} | {f"じゅう{k}": str(10 + v) for k, v in KANA}
    for tens in range(10):
        for ones in range(10):
            if tens or ones:
                out[("" if tens == 0 else "十" if tens == 1 else KANJI[tens - 1] + "十") + ("" if ones == 0 else KANJI[ones - 1])] = str(10 * tens + ones)
    return out


def longest_first(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


JAPANESE = "ぁ-ヿ㐀-䶿一-鿿々"
_SPELLED = source_tokens()
_KANA_WORDS = longest_first(w for w in _SPELLED if not set(w) & set(KANJI + "十零〇"))
#: Digits, kanji numerals, and kana readings that stand alone.
SOURCE_TOKEN = f"\\d{{1,2}}|{longest_first(w for w in _SPELLED if set(w) & set(KANJI + '十零〇'))}|(?<![{JAPANESE}])(?:{_KANA_WORDS}|ゼロ|レイ)(?![{JAPANESE}])"


def source_matches(text: Column) -> Column:
    """array<struct<value, raw>>: the number tokens of a text; none if it has a decimal number."""
    token = lambda raw: F.struct(F.coalesce(F.when(F.regexp_like(raw, F.lit("^\\d+$")), raw), look_up(_SPELLED, raw), look_up(_SPELLED, hiragana(raw))).cast("int").alias("value"), raw.alias("raw"))
    # kana are matched as hiragana, which has as many characters
    found = let(plain(F.coalesce(text, F.lit(""))), lambda t: F.when(F.regexp_like(t, F.lit("\\d[.．]\\d")), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(hiragana(t), F.lit(SOURCE_TOKEN), F.lit(0))))
    return F.transform(found, token)


def source_values(text: Column) -> Column:
    """The values of a text that holds number tokens and separators only; null otherwise."""
    rest = F.regexp_replace(hiragana(plain(F.coalesce(text, F.lit("")))), SOURCE_TOKEN, "")
    only = F.regexp_like(rest, F.lit("^[\\s,，、。!！?？・:：;；／/\\\\\\-~〜…]*$"))
    return let(source_matches(text), lambda m: F.when(only & (F.size(m) > 0), F.transform(m, lambda x: x["value"])))


def embedded_countdown(text: Column) -> Column:
    """The number tokens of a text, if their values are a countdown, whatever stands between them; null otherwise."""
    return let(source_matches(text), lambda m: F.when(is_countdown(F.transform(m, lambda x: x["value"])), m))


def repaired_values(values: Column, least: int = 4) -> Column:
    """A countdown from values that are one but for a repeated end, one value left out or one wrong value; null if there is nothing to mend or no such way."""

    def mended(v: Column) -> Column:
        n, first = F.size(v), F.get(v, 0)
        d = steps(v)
        run = F.coalesce(F.array_position(F.transform(d, lambda x: (x != -1).cast("int")), F.lit(1)), F.lit(0)).cast("int")
        head = F.when(run == 0, n).otherwise(run)
        tail = F.slice(v, head + 1, F.greatest(n - head, F.lit(1)))
        repeated = (head >= least) & (head < n) & F.forall(tail, lambda x: x == F.get(v, head - 1))
        down = F.sequence(first, F.element_at(v, -1), F.lit(-1).cast("int"))
        left_out = (F.size(F.filter(d, lambda x: x == -2)) == 1) & F.forall(d, lambda x: x.isin(-1, -2))
        expected = F.transform(v, lambda x, i: first - i)
        wrong = F.size(F.filter(F.zip_with(v, expected, lambda a, b: a != b), lambda x: x))
        good = (n >= least) & ~is_countdown(v)
        return F.when(good & repeated, F.slice(v, 1, head)).when(good & left_out, F.when(left_out, down)).when(good & (F.element_at(expected, -1) >= 0) & (wrong == 1), expected)

    return F.when(F.size(values) > 0, let(F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(0))).cast("array<int>"), mended))


def repaired_text(text: Column, least: int = 4) -> Column:
    """A countdown that was mended, as digits; null if there was nothing to mend."""
    return F.array_join(F.transform(repaired_values(source_values(text), least), lambda v: v.cast("string")), " ")


def repair_hits(text: Column) -> Column:
    """struct<text, hits>: a countdown mended, with one hit row of what was replaced by what."""
    hit = lambda new: F.struct(text.alias("source"), new.alias("target"), F.lit(1).alias("count"))
    return let(repaired_text(text), lambda new: F.struct(F.coalesce(new, text).alias("text"), F.array_compact(F.array(F.when(new.isNotNull(), hit(new)))).alias("hits")))


def numeral(value: Column, ones: list[str], tens: list[str]) -> Column:
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    high, low = F.floor(value / 10), value % 10
    return F.when((value >= 0) & (value <= 99), F.when(value < 10, pick(ones, value)).otherwise(F.concat(pick(tens, high), F.when(low == 0, "").otherwise(pick(ones, low)))))


def native_numeral(value: Column) -> Column:
    """0 to 99 in native Korean numerals; null beyond."""
    return numeral(value, NATIVE_ONES, NATIVE_TENS)


def sino_numeral(value: Column) -> Column:
    """0 to 99 in Sino-Korean numerals; null beyond."""
    return numeral(value, DIGITS, ["", "십", *[d + "십" for d in DIGITS[2:]]])


def _numeral_words(native_only: bool = False) -> dict[str, str]:
    out = {}
    for v in range(100):
        tens, ones = divmod(v, 10)
        out[(NATIVE_TENS[tens] + (NATIVE_ONES[ones] if ones else "")) or NATIVE_ONES[0]] = str(v)
        if not native_only:
            out[((("" if tens == 1 else DIGITS[tens]) + "십") if tens else "") + (DIGITS[ones] if ones or not tens else "")] = str(v)
    return out if native_only else out | {"공": "0"}


_WORDS, _NATIVE = _numeral_words(), _numeral_words(True)
TOKEN = f"(?<![0-9A-Za-z가-힣])(?:\\d{{1,2}}|{longest_first(_WORDS)})(?![0-9A-Za-z가-힣])"


def token_value(token: Column) -> Column:
    """The value of a Korean numeral or of one or two digits without a leading zero; null for other words."""
    return F.coalesce(F.when(F.regexp_like(token, F.lit("^(0|[1-9]\\d?)$")), token), look_up(_WORDS, token)).cast("int")


def korean_values(text: Column) -> Column:
    """The values of a text: numerals that are words of their own, longer runs of digits digit by digit, and native numerals written together."""
    native = longest_first(_NATIVE)

    def block(b: Column) -> Column:
        parts = F.regexp_extract_all(b, F.lit(native), F.lit(0))
        run = F.when((F.array_join(parts, "") == b) & (F.size(parts) >= 2), F.transform(parts, lambda p: look_up(_NATIVE, p).cast("int"))).otherwise(F.array().cast("array<int>"))
        digits = F.transform(F.split(b, ""), lambda d: F.when(F.regexp_like(d, F.lit("^\\d$")), d).cast("int"))
        return F.when(token_value(b).isNotNull(), F.array(token_value(b))).when(F.regexp_like(b, F.lit("^\\d{2,}$")), digits).otherwise(run)

    return F.flatten(F.transform(F.regexp_extract_all(plain(F.coalesce(text, F.lit(""))), F.lit("[0-9A-Za-z가-힣]+"), F.lit(0)), lambda b: let(b, block)))


def periodized(text: Column, least: int = 3) -> Column:
    """struct<text, runs, filler_removed>: runs of at least ``least`` numerals in native form with a full stop after each; runs is null if nothing changed."""
    run = f"{TOKEN}(?:[{SEPARATORS}]+{TOKEN}){{{least - 1},}}[.!?。！？]*"

    def native(m: Column) -> Column:
        tokens = F.regexp_extract_all(m, F.lit(TOKEN), F.lit(0))
        return F.concat(F.array_join(F.transform(tokens, lambda t: F.coalesce(native_numeral(token_value(t)), t)), ". "), F.lit("."))

    def made(t: Column, out: Column, found: Column) -> Column:
        after = F.regexp_extract(t, f"^\\s*(?:{run})(.*)$", 1)
        filler = (F.size(found) == 1) & F.regexp_like(t, F.lit(f"^\\s*(?:{run})")) & F.regexp_like(after, F.lit(FILLER))
        new = F.when(filler, native(F.get(found, 0))).otherwise(F.trim(out))
        changed = (F.size(found) > 0) & (new != t)
        return F.struct(F.when(changed, new).otherwise(t).alias("text"), F.when(changed, F.size(found)).alias("runs"), (changed & filler).alias("filler_removed"))

    return let(plain(F.coalesce(text, F.lit(""))), lambda t: let(replaced(t, run, native), lambda out: let(F.regexp_extract_all(t, F.lit(run), F.lit(0)), lambda found: made(t, out, found))))


def render_plan(values: Column) -> Column:
    """struct<kind, text, variant, policy, groups> of at least three values: the countdown from ten, other countdowns, and other cadences; null for less."""
    tokens = F.transform(values, native_numeral)
    full, down = values == F.array(*[F.lit(v) for v in range(10, 0, -1)]), is_countdown(values)
    pick = lambda *x: F.when(full, F.lit(x[0])).when(down, F.lit(x[1])).otherwise(F.lit(x[2]))
    text = F.when(full, F.array_join(tokens, ", ")).when(down, F.array_join(tokens, " ")).otherwise(F.array_join(tokens, ". "))
    groups = F.when(full, F.array(F.slice(values, 1, 1), F.slice(values, 2, 9))).otherwise(F.array(values))
    plan = F.struct(pick("countdown_10_to_1", "descending_countdown", "numeric_cadence").alias("kind"), F.concat(text, F.lit(".")).alias("text"), pick("native_countdown", "native_spaces", "native_periods_no_compact").alias("variant"), pick("head_single_rest", "whole_span_guard120_pad350", "whole_span_guard120_pad350").alias("policy"), groups.alias("groups"))
    return F.when((F.size(values) >= 3) & F.forall(tokens, lambda t: t.isNotNull()), plan)


def sequence_check(expected: str, observed: str, least: int = 3, contiguous: bool = True) -> Column:
    """struct<ordered, contiguous, missing, gate, issues> of two columns of values: whether all expected ones are heard in order, and without others between."""
    from timeloom.functions.numeric import contains_run, missing_values

    e, o = F.col(expected), F.col(observed)
    missing, run = missing_values(expected, observed), contains_run(observed, expected)
    short, silent = F.size(e) < least, F.size(o) == 0
    ordered = F.size(missing) == 0
    issues = F.array_compact(F.array(F.when(~ordered, "numeric_sequence_order_mismatch"), F.when(~ordered, "numeric_sequence_missing_values"), F.when(F.lit(contiguous) & ~run, "numeric_sequence_contiguous_mismatch")))
    gate = F.when(short, "unavailable").when(~silent & ordered & (run | ~F.lit(contiguous)), "pass").otherwise("fail")
    issues = F.when(short, F.array(F.lit("numeric_sequence_too_short"))).when(silent, F.array(F.lit("empty_numeric_transcript"))).otherwise(issues)
    none = F.slice(missing, 1, 0)
    return F.struct((short | (~silent & ordered)).alias("ordered"), (short | (~silent & run)).alias("contiguous"), F.when(short, none).otherwise(missing).alias("missing"), gate.alias("gate"), issues.alias("issues"))


def slot_budget(seconds: Column, per_second: float = 4.0, allowance: float = 1.12) -> Column:
    """struct<least, target, most>: letters that a slot of some seconds takes."""
    target = F.greatest(F.lit(4), F.floor(F.greatest(F.lit(0.0), seconds) * per_second)).cast("int")
    most = F.greatest(target + 2, F.floor(target * allowance).cast("int"), F.lit(6))
    return F.struct(F.least(F.greatest(F.lit(4), F.floor(target * 0.55).cast("int")), most).alias("least"), target.alias("target"), most.alias("most"))
