"""Text as it is to be spoken: cues in brackets, letters and numbers in words, punctuation, clauses of bounded length. All are column expressions.

A null text stays null. ``korean`` and ``japanese`` return struct<text, cues, flags>.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeloom.functions.text import rewrite

# Readings of digits, of the letters A to Z, of tokens and of symbols.
DIGITS = ["영", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구"]
LETTERS = ["에이", "비", "씨", "디", "이", "에프", "지", "에이치", "아이", "제이", "케이", "엘", "엠", "엔", "오", "피", "큐", "알", "에스", "티", "유", "브이", "더블유", "엑스", "와이", "제트"]
TOKENS = {"ai": "에이아이", "asmr": "에이에스엠알", "gpt": "지피티", "gpt-sovits": "지피티 소비츠", "ok": "오케이", "rvc": "알브이씨", "sns": "에스엔에스", "sovits": "소비츠", "tts": "티티에스", "url": "유알엘", "usb": "유에스비"}
SYMBOLS = {"&": " 그리고 ", "@": " 골뱅이 ", "%": " 퍼센트 ", "+": " 플러스 ", "=": " 는 ", "/": " 슬래시 ", "\\": " 슬래시 ", "#": " 샵 ", "$": " 달러 ", "€": " 유로 ", "₩": " 원 ", "°": " 도 ", "—": "…", "–": "…", "―": "…", ":": ", ", ";": ", "}
BLANK_SYMBOLS = "~-−_|\"'“”‘’「」『』*`<>"
JAPANESE_TOKENS = {"ASMR": "エーエスエムアール", "OK": "オーケー"}
COUNTERS = {"1": "いっ", "2": "に", "3": "さん", "4": "よん", "5": "ご", "6": "ろっ", "7": "なな", "8": "はっ", "9": "きゅう", "10": "じゅう"}
HEARTS = "[♡♥❤💕💗]"
BRACKETED = r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|（[^）]*）|【[^】]*】|｛[^｝]*｝|〈[^〉]*〉|《[^》]*》"
CUE_WORDS = [("laugh", "laugh", "笑|くす|laugh"), ("spatial", "ear_close", "耳|左|右|近|pan"), ("breath", "breath", "息|吐息|呼吸|breath"), ("pause", "pause", "間|待|沈黙|pause"), ("style", "whisper", "小声|囁|ささや|whisper"), ("mouth_sound", "mouth_sound", "リップ|口|mouth")]
CLAUSE_CHARS = 44

SPACES = "[\\s\\u00a0\\u3000]+"
CUE = "struct<kind:string,source:string,normalized:string,position:int,pause:double>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def replaced(text: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """Every match of a regular expression replaced by ``f`` of it (null: by nothing)."""

    def put_together(t: Column) -> Column:
        between, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return let(found, lambda m: F.array_join(F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(let(F.get(m, i), f), F.lit(""))))), ""))

    return let(text, put_together)


def table(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def look_up(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(table(entries), key)


def pause_hint(content: Column) -> Column:
    """Seconds of a pause: a number with its unit, or what words for long, short or some pause stand for; null if none."""
    low = F.lower(content)
    number, unit = (F.regexp_extract(low, "(\\d+(?:\\.\\d+)?)\\s*(秒|sec(?:onds?)?|s|ms)", k) for k in (1, 2))
    value = F.when(number != "", number.cast("double"))
    named = F.when(F.regexp_like(low, F.lit("長|しばらく|沈黙|long")), 0.8).when(F.regexp_like(low, F.lit("短|一拍|short")), 0.25).when(F.regexp_like(low, F.lit("間|待|pause")), 0.45)
    return F.coalesce(F.when(unit == "ms", value / 1000).otherwise(value), named)


def cues(text: Column) -> Column:
    """Bracketed directions in order: kind, source, normalised text, position and, for a pause, its seconds."""
    width = lambda parts: F.aggregate(parts, F.lit(0), lambda a, t: a + F.length(t))

    def one(source: Column, i: Column, between: Column, found: Column) -> Column:
        content = F.regexp_replace(source, "^[()\\[\\]{}（）【】｛｝〈〉《》]+|[()\\[\\]{}（）【】｛｝〈〉《》]+$", "")
        low = F.lower(content)
        pick = lambda k, rest: F.coalesce(*[F.when(F.regexp_like(low, F.lit(w[2])), F.lit(w[k])) for w in CUE_WORDS], rest)
        kind = pick(0, F.lit("stage_direction"))
        at = width(F.slice(between, 1, i + 1)) + width(F.slice(found, 1, i))
        return F.struct(kind.alias("kind"), source.alias("source"), pick(1, content).alias("normalized"), at.alias("position"), F.when(kind == "pause", pause_hint(content)).alias("pause"))

    def all_of(parts: Column) -> Column:
        return F.transform(parts["found"], lambda source, i: one(source, i, parts["between"], parts["found"]))

    parts = F.struct(F.split(text, BRACKETED, -1).alias("between"), F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(0)).alias("found"))
    return let(parts, all_of).cast(f"array<{CUE}>")


def without_cues(text: Column) -> Column:
    return F.regexp_replace(text, BRACKETED, "")


def digit_by_digit(digits: Column, by: str = "") -> Column:
    return F.array_join(F.transform(F.split(digits, ""), lambda d: F.get(F.array(*map(F.lit, DIGITS)), d.cast("int"))), by)


def below_ten_thousand(value: Column) -> Column:
    """Units by thousands, hundreds and tens; a one before a unit is silent. Empty for 0."""
    digit = lambda d: F.get(F.array(*map(F.lit, DIGITS)), d.cast("int"))
    parts = []
    for size, name in ((1000, "천"), (100, "백"), (10, "십")):
        q = F.floor(value / size) % 10
        parts.append(F.when(q == 0, "").when(q == 1, name).otherwise(F.concat(digit(q), F.lit(name))))
    ones = value % 10
    return F.concat(*parts, F.when(ones == 0, "").otherwise(digit(ones)))


def integer_words(value: Column) -> Column:
    """A whole number in words; from 100,000 on digit by digit."""
    v = value.cast("long")
    high, low = F.floor(v / 10_000), v % 10_000
    large = F.concat(F.when(high == 1, "").otherwise(below_ten_thousand(high)), F.lit("만"), below_ten_thousand(low))
    return F.when(v == 0, DIGITS[0]).when(v >= 100_000, digit_by_digit(v.cast("string"))).when(v >= 10_000, large).otherwise(below_ten_thousand(v))


def number_words(token: Column) -> Column:
    """A token of digits, perhaps with a decimal point; leading zeros are read out."""
    whole, rest = F.regexp_extract(token, "^(\\d+)", 1), F.regexp_extract(token, "\\.(\\d+)$", 1)
    long_or_zero = (F.length(whole) > 1) & (whole.startswith("0") | (F.length(whole) > 5))
    spoken = F.when(long_or_zero, digit_by_digit(whole)).otherwise(integer_words(F.when(~long_or_zero, whole.cast("long"))))
    return F.when(token != "", F.concat(spoken, F.when(rest == "", "").otherwise(F.concat(F.lit("점"), digit_by_digit(rest)))))


def latin_words(token: Column) -> Column:
    """A token of Latin letters: known ones have a reading, others are spelled, part by part."""
    letter = lambda c: F.get(F.array(*map(F.lit, LETTERS)), F.ascii(F.upper(c)) - 65)
    spell = lambda part: F.coalesce(look_up(TOKENS, F.lower(part)), F.array_join(F.transform(F.split(part, ""), letter), ""))
    parts = F.filter(F.split(token, "[-_]+"), lambda p: p != "")
    return F.coalesce(look_up(TOKENS, F.replace(F.lower(token), F.lit("_"), F.lit("-"))), F.array_join(F.transform(parts, spell), " "))


def symbols_spoken(text: Column) -> Column:
    text = replaced(text, "[" + "".join("\\" + c if c in "\\&" else c for c in SYMBOLS) + "]", lambda c: look_up(SYMBOLS, c))
    return F.translate(text, BLANK_SYMBOLS, " " * len(BLANK_SYMBOLS))


def korean_punctuation(text: Column) -> Column:
    """One form of each mark, none doubled, no space before and one after, no mark before the first syllable."""
    start = [("\\r\\n?", "\n"), (SPACES, " "), ("\\.{3,}|…+|⋯+", "…")]
    marks = F.translate(rewrite(text, start), "､｡。、！？", ",..,!?")
    rest = [("\\.{4,}", "..."), (",{2,}", ","), ("!{2,}", "!"), ("\\?{2,}", "?"), ("^[\\s、。！？,.!?]+(?=\\s*[가-힣])", ""), ("\\s*([,.!?…])\\s*", "$1"), ("([,.!?])[,.!?]+", "$1"), ("([,.!?…])(?=[^\\s,.!?…])", "$1 "), (SPACES, " ")]
    return F.trim(rewrite(marks, rest))


def japanese_punctuation(text: Column) -> Column:
    start = [("\\r\\n?", "\n"), (SPACES, " "), ("\\.{3,}|…+|⋯+", "……")]
    marks = F.translate(rewrite(text, start), ",､.｡!?", "、、。。！？")
    rest = [("。{2,}", "。"), ("、{2,}", "、"), ("！{2,}", "！"), ("？{2,}", "？"), ("(?:……){2,}", "……"), ("\\s*([、。！？])\\s*", "$1"), ("([、。！？])[、。！？]+", "$1"), (SPACES, " ")]
    return F.trim(rewrite(marks, rest))


def clause_chars(text: Column) -> Column:
    """Characters that are spoken: no space and no mark."""
    return F.length(F.regexp_replace(text, "[\\s\\u3000,.!?…]", ""))


def split_clauses(text: Column, most: int = CLAUSE_CHARS) -> Column:
    """Struct of text and changed: a sentence with more than ``most`` spoken characters gets commas between words, as late as each clause allows."""
    sentences = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^.!?]*[.!?]|[^.!?]+"), F.lit(0)), F.trim), lambda s: s != "")

    def one(sentence: Column) -> Column:
        return let(F.trim(F.regexp_replace(sentence, "[.!?]$", "")), lambda body: one_body(sentence, body))

    def one_body(sentence: Column, body: Column) -> Column:
        mark = F.regexp_extract(sentence, "([.!?])$", 1)
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("cuts"))

        def step(a: Column, word: Column) -> Column:
            n = clause_chars(word)
            cut = (a["out"] != "") & (a["n"] + n > most)
            return F.struct(F.when(a["out"] == "", word).when(cut, F.concat(a["out"], F.lit(", "), word)).otherwise(F.concat(a["out"], F.lit(" "), word)).alias("out"), F.when(cut, n).otherwise(a["n"] + n).alias("n"), (a["cuts"] + cut.cast("int")).alias("cuts"))

        long = F.aggregate(F.split(body, " "), start, step)
        short = clause_chars(body) <= most
        return let(long, lambda x: F.struct(F.concat(F.when(short, body).otherwise(x["out"]), mark).alias("text"), F.when(short, 0).otherwise(x["cuts"]).alias("cuts")))

    return let(F.transform(sentences, one), lambda made: F.struct(F.array_join(F.transform(made, lambda m: m["text"]), " ").alias("text"), F.exists(made, lambda m: m["cuts"] > 0).alias("changed")))


def hearts(text: Column) -> Column:
    """A cue of soft affect for each heart, with its position."""
    chars = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    found = F.filter(chars, lambda x: F.regexp_like(x["c"], F.lit(HEARTS)))
    return F.transform(found, lambda x: F.struct(F.lit("soft_affect").alias("kind"), x["c"].alias("source"), F.lit("soft_affect").alias("normalized"), x["i"].cast("int").alias("position"), F.lit(None).cast("double").alias("pause"))).cast(f"array<{CUE}>")


def without_pictures(text: Column) -> Column:
    return F.regexp_replace(text, f"{HEARTS}|[\\x{{1F300}}-\\x{{10FFFF}}]", "")


LATIN, NUMBER = "[A-Za-z]+(?:[-_][A-Za-z]+)*", "\\d+(?:\\.\\d+)?"
SYMBOL = "[" + "".join("\\" + c if c in "\\&-" else c for c in [*SYMBOLS, *BLANK_SYMBOLS]) + "]"


def korean_words(text: Column) -> Column:
    """struct<words, spoken, latin, number, symbol>: the text before clauses are split, that before hearts and pictures went, and what has been met."""

    def last(plain: Column, worded: Column, counted: Column) -> Column:
        met = [F.regexp_like(t, F.lit(p)).alias(name) for t, p, name in ((plain, LATIN, "latin"), (worded, NUMBER, "number"), (counted, SYMBOL, "symbol"))]
        return let(symbols_spoken(counted), lambda out: F.struct(korean_punctuation(F.regexp_replace(without_pictures(out), "[*_`#>]", "")).alias("words"), out.alias("spoken"), *met))

    return let(without_cues(text), lambda plain: let(replaced(plain, LATIN, latin_words), lambda worded: let(replaced(worded, NUMBER, number_words), lambda counted: last(plain, worded, counted))))


def flagged(tests: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))


def korean(text: Column) -> Column:
    """struct<text, cues, flags>: cues out, Latin letters, numbers and symbols in words, pictures out, marks and spaces in order, long clauses split."""

    def made(w: Column, split: Column) -> Column:
        flags = [(w["latin"], "normalized_latin_token"), (w["number"], "normalized_numeric_token"), (w["symbol"], "normalized_symbol_token"), (split["changed"], "split_long_korean_clause"), (split["text"] != F.trim(text), "normalized_tts_text"), (split["text"] == "", "tts_text_empty")]
        return F.struct(split["text"].alias("text"), F.concat(cues(text), hearts(w["spoken"])).alias("cues"), flagged(flags).alias("flags"))

    return F.when(text.isNotNull(), let(korean_words(text), lambda w: let(split_clauses(w["words"]), lambda split: made(w, split))))


def japanese(text: Column) -> Column:
    """struct<text, cues, flags>: cues and pictures out, known tokens and counted minutes and seconds in words, marks and spaces in order."""
    plain = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), JAPANESE_TOKENS.items(), without_cues(text))
    counter = "\\d+(?:分|秒)"

    def words(token: Column) -> Column:
        number, unit = F.regexp_extract(token, "^(\\d+)", 1), F.regexp_extract(token, "(分|秒)$", 1)
        read = F.when((number == "3") & (unit == "分"), "さんぷん").otherwise(F.concat(look_up(COUNTERS, number), F.when(unit == "分", "ぷん").otherwise("びょう")))
        return F.coalesce(read, token)

    def made(counted: Column, out: Column) -> Column:
        flags = [(F.regexp_like(counted, F.lit(counter)), "unhandled_numeric_token"), (out != F.trim(text), "normalized_tts_text"), (out == "", "tts_text_empty")]
        return F.struct(out.alias("text"), F.concat(cues(text), hearts(counted)).alias("cues"), flagged(flags).alias("flags"))

    return F.when(text.isNotNull(), let(replaced(plain, counter, words), lambda counted: let(japanese_punctuation(without_pictures(counted)), lambda out: made(counted, out))))


def spoken(text: Column, language: Column) -> Column:
    """By language: Korean, or as Japanese."""
    return F.when(F.lower(F.trim(language)).isin("ko", "kr", "kor", "korean"), korean(text)).otherwise(japanese(text))


def kana_reading(text: Column) -> Column:
    """struct<text, changed, flags>: marks and spaces in order and katakana as hiragana. Readings of ideographs need a dictionary, and are flagged as left over."""
    katakana, hiragana = "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097)))

    def made(original: Column, out: Column) -> Column:
        left = F.regexp_like(out, F.lit("[㐀-䶿一-鿿々〆〤A-Za-z0-9]"))
        flags = F.when(original == "", F.array(F.lit("japanese_kana_text_empty"))).otherwise(flagged([(out != original, "normalized_japanese_kana_text"), (left, "remaining_non_kana_japanese_text")]))
        return F.struct(out.alias("text"), (out != original).alias("changed"), flags.alias("flags"))

    return let(F.trim(F.coalesce(text, F.lit(""))), lambda t: let(F.translate(japanese_punctuation(t), katakana, hiragana), lambda out: made(t, out)))


#: Ends at which a sentence looks cut off.
OPEN_END = "(?:다음\\s+[가-힣]{1,2}|말고,\\s*[가-힣]{1,4}|[가-힣]+\\s+말고\\s+[가-힣]{1,4})$"
OPEN_WORD = "(?:그리고|그런데|하지만|또는|혹은|말고|다음)$"


def cut_off(text: Column) -> Column:
    """Whether a text ends in a comma, a fragment or a word that leads on."""
    t = F.trim(F.regexp_replace(text, "\\s+", " "))
    last = F.trim(F.element_at(F.split(t, "[,!?…]+", -1), -1))
    return (t != "") & (t.endswith(",") | F.regexp_like(t, F.lit(OPEN_END)) | (last == "푸") | F.regexp_like(last, F.lit(OPEN_WORD)))


def repair_cut_off(text: Column) -> Column:
    """struct<text, repaired>: a text that is cut off gets dots instead of its last comma."""
    base = F.regexp_replace(F.trim(F.regexp_replace(text, "\\s+", " ")), "[ ,，、]+$", "")
    hit = cut_off(text) & (base != "")
    return F.struct(F.when(hit, F.concat(base, F.lit("..."))).otherwise(F.trim(text)).alias("text"), hit.alias("repaired"))


def text_policy(text: Column, language: Column, source: Column, least_share: float = 0.20) -> Column:
    """Issues of a Korean text that is to be spoken, in order; the language is that of the text, the source what it was translated from."""
    t, src = F.trim(text), F.trim(F.coalesce(source, F.lit("")))
    has = lambda pattern: F.regexp_like(t, F.lit(pattern))
    kept = F.regexp_replace(t, "[\\s\\d]", "")
    share = F.coalesce(F.try_divide(F.length(F.regexp_replace(kept, "[^가-힣]", "")), F.length(kept)), F.lit(0.0))
    long = F.exists(F.split(t, "[,.!?…]+"), lambda c: F.length(F.regexp_replace(c, "\\s", "")) > CLAUSE_CHARS)
    tests = [
        (F.replace(F.lower(F.trim(language)), F.lit("kr"), F.lit("ko")) != "ko", "tts_language_not_ko"),
        (t == "", "korean_tts_text_empty"),
        (has("[\\u3040-\\u30ff]"), "korean_tts_contains_kana"),
        (has(BRACKETED), "korean_tts_contains_stage_direction"),
        (has("[A-Za-z]"), "korean_tts_contains_latin"),
        (has("\\d"), "korean_tts_contains_digit"),
        (has("[^가-힣\\s,.!?…]"), "korean_tts_contains_pronunciation_symbol"),
        (long, "korean_tts_long_clause_without_pause"),
        (cut_off(t), "korean_tts_suspicious_truncated_sentence"),
        ((src != "") & (t == src), "korean_tts_matches_source_japanese"),
        ((src != "") & ~has("[가-힣]"), "korean_tts_missing_hangul"),
        ((t != "") & (share < least_share), "korean_tts_hangul_ratio_too_low"),
    ]
    return flagged(tests)


# Contractions, endings and nouns of spoken Korean; shorter forms and acronyms.
CONTRACTIONS = [("이것은", "이건"), ("그것은", "그건"), ("저것은", "저건"), ("이것을", "이걸"), ("그것을", "그걸"), ("저것을", "저걸"), ("이것이", "이게"), ("그것이", "그게"), ("저것이", "저게"), ("저는", "전"), ("나는", "난"), ("너는", "넌"), ("나를", "날"), ("너를", "널"), ("것은", "건"), ("것을", "걸"), ("것이", "게"), ("무엇을", "뭘"), ("무엇이", "뭐가"), ("무엇은", "뭐는"), ("무엇", "뭐")]
ENDINGS = [("것입니다", "거예요"), ("해드리겠습니다", "해드릴게요"), ("드리겠습니다", "드릴게요"), ("시작하겠습니다", "시작할게요"), ("해보겠습니다", "해볼게요"), ("하겠습니다", "할게요"), ("보겠습니다", "볼게요"), ("가겠습니다", "갈게요"), ("오겠습니다", "올게요"), ("알겠습니다", "알겠어요"), ("모르겠습니다", "잘 모르겠어요"), ("했습니다", "했어요"), ("하였습니다", "했어요"), ("합니다", "해요"), ("드립니다", "드려요"), ("됩니다", "돼요"), ("되었습니다", "됐어요"), ("됐습니다", "됐어요"), ("있습니다", "있어요"), ("없습니다", "없어요"), ("같습니다", "같아요"), ("싶습니다", "싶어요"), ("괜찮습니다", "괜찮아요"), ("좋습니다", "좋아요"), ("아닙니다", "아니에요"), ("맞습니다", "맞아요"), ("해드립니까", "해드릴까요"), ("드립니까", "드릴까요"), ("하겠습니까", "할까요"), ("합니까", "해요"), ("됩니까", "돼요"), ("있습니까", "있어요"), ("없습니까", "없어요"), ("괜찮습니까", "괜찮아요"), ("좋습니까", "좋아요"), ("맞습니까", "맞아요")]
COPULA_NOUNS = ["거", "문장", "번역", "소리", "느낌", "시간", "부분", "곳", "중", "편", "상태", "준비", "마지막", "처음", "다음", "여기", "거기", "저기"]
SHORTER = [("반드시", "꼭"), ("그렇게", "그리"), ("되어요", "돼요"), ("거예요", "예요"), ("합니다", "해요"), ("습니다", "요"), ("이에요", "예요"), ("풀어요", "풀어"), ("밀어요", "밀어")]
ACRONYMS = [("ASMR", "에이에스엠알"), ("TTS", "티티에스"), ("OK", "오케이")]


def colloquial(text: Column) -> Column:
    """Stiff written Korean in polite spoken forms; a text without Hangul is only trimmed."""
    t = F.trim(text)
    rules = [(f"(?<![가-힣]){a}(?![가-힣])", b) for a, b in CONTRACTIONS]
    rules += [(f"{a}(?=$|[\\s,.!?])", b) for a, b in sorted(ENDINGS, key=lambda e: -len(e[0]))]
    out = rewrite(t, rules)
    copula = "(?:" + "|".join(COPULA_NOUNS) + ")입니다(?=$|[\\s,.!?])"
    # a syllable's final consonant is its place among the 28 forms of its block
    last = lambda m: F.pmod(F.conv(F.hex(F.encode(F.substring(m, -4, 1), "UTF-16BE")), 16, 10).cast("int") - 0xAC00, F.lit(28))
    out = replaced(out, copula, lambda m: F.concat(F.regexp_replace(m, "입니다$", ""), F.when(last(m) != 0, "이에요").otherwise("예요")))
    tidy = F.trim(rewrite(out, [("\\s+", " "), ("\\s+([,.!?])", "$1"), ("([,.!?])(?=[^\\s,.!?])", "$1 ")]))
    return F.when(F.regexp_like(t, F.lit("[가-힣]")), tidy).otherwise(t)


def sanitized(text: Column) -> Column:
    """Acronyms and numbers in words, brackets and quotes as spaces."""
    t = rewrite(text, [(f"(?i)(?U)\\b{a}\\b", b) for a, b in ACRONYMS])

    def read(token: Column) -> Column:
        short = (F.length(token) <= 4) & ~token.startswith("0")
        return F.when(token == "0", DIGITS[0]).when(short, below_ten_thousand(F.when(short, token.cast("int")))).otherwise(digit_by_digit(token, " "))

    t = F.translate(replaced(t, "\\d+", read), "()[]{}/\\:;—–―「」『』“”‘’", " " * 21)
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def spoken_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]", ""))


def fitted(text: Column, most: Column) -> Column:
    """The first form with at most ``most`` letters: as it is, with one shortening after the other, then without its last words; as it is if none fits."""
    tidy = lambda t: F.trim(F.regexp_replace(t, "\\s+", " "))
    shorter = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SHORTER])

    def found(t: Column) -> Column:
        forms = F.aggregate(shorter, F.array(t), lambda out, s: F.concat(out, F.array(tidy(F.replace(F.element_at(out, -1), s["a"], s["b"])))))
        return let(forms, lambda f: let(F.split(F.element_at(f, -1), " "), lambda words: pick(t, f, words)))

    def pick(t: Column, forms: Column, words: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda k: F.array_join(F.slice(words, 1, F.greatest(F.size(words) - k, F.lit(0))), " "))
        good = F.filter(F.concat(forms, cut), lambda x: (x != "") & (spoken_length(x) <= F.greatest(most, F.lit(1))))
        return F.coalesce(F.get(good, 0), t)

    return let(tidy(text), found)


def speakable(text: Column) -> Column:
    """Hangul and marks, and nothing else."""
    return F.regexp_like(text, F.lit("[가-힣]")) & ~F.regexp_like(text, F.lit("[^가-힣\\s,.!?…]"))


def salvaged(natural: Column, literal: Column, most: Column) -> Column:
    """The natural form, cleaned and fitted, or else the literal one; null if neither can be spoken within ``most`` letters."""
    fits = lambda t: spoken_length(t) <= most
    forms = F.struct(fitted(sanitized(natural), most).alias("n"), fitted(sanitized(literal), most).alias("alt"))
    best = let(forms, lambda f: F.when(~fits(f["n"]) & speakable(f["alt"]) & fits(f["alt"]), f["alt"]).otherwise(f["n"]))
    return let(best, lambda b: F.when(speakable(b) & fits(b), b))


def rewritten_for_duration(text: Column, target: Column, per_second: float = 4.0, tolerance: float = 0.15) -> Column:
    """struct<text, flag>: a text whose estimated seconds are off by more than the tolerance is fitted or gets a few words more; null target: as it is."""
    estimate = spoken_length(text) / per_second
    off = (target > 0) & (F.abs(estimate - target) / F.when(target > 0, target) > tolerance)
    most = F.greatest(F.lit(4), F.floor(target * per_second)).cast("int")
    longer = F.concat(F.regexp_replace(text, "[.!?。！？ ]+$", ""), F.lit("... 괜찮아요."))
    hit = F.coalesce(off, F.lit(False))
    return F.struct(F.when(hit & (estimate > target), fitted(text, most)).when(hit, longer).otherwise(text).alias("text"), F.when(hit & (estimate > target), "duration_rewrite_shortened").when(hit, "duration_rewrite_lengthened").alias("flag"))


def backend_name(name: Column) -> Column:
    """One spelling of a name: small letters, underscores; a renderer of countdowns goes by the name of its backend."""
    return F.regexp_replace(F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_")), "^(gpt_sovits)_countdown_renderer$", "$1")


def hangul_units(text: Column) -> Column:
    """The Hangul syllables of a text, its digits read one by one (full-width ones too)."""
    plain = F.translate(text, "０１２３４５６７８９", "0123456789")
    return F.regexp_replace(F.translate(plain, "0123456789", "".join(DIGITS)), "[^가-힣]", "")
