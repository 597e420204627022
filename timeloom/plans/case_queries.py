"""Text operators on fixed lines: every order gets one of the lines by its key, and the SQL has what the operator must give for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeloom.functions import counting, spoken
from timeloom.plans.catalog import query
from timeloom.sources.tables import load


def literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def cases(name: str, f: Callable[[Column], Column], pairs: list[tuple[str, str | None]]) -> None:
    """Registers a query that applies ``f`` to the first of each pair, and the SQL that returns the second."""
    k = len(pairs)
    want = ", ".join(literal(b) for _, b in pairs)

    @query(name, f"SELECT o_orderkey, ([{want}])[CAST(o_orderkey % {k} AS INT) + 1] AS out FROM orders")
    def run(spark, sf):
        text = F.get(F.array(*[F.lit(a) for a, _ in pairs]), (F.col("o_orderkey") % k).cast("int"))
        df = load(spark, sf, "orders").select("o_orderkey", text.alias("text"))
        return df.select("o_orderkey", f(F.col("text")).alias("out"))


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def cue_text(c: Column) -> Column:
    return F.concat_ws(":", c["kind"], c["normalized"], c["position"].cast("string"), F.coalesce(c["pause"].cast("string"), F.lit("-")))


cases(
    "bracketed_cues",
    lambda t: F.concat(spoken.without_cues(t), F.lit("|"), F.array_join(F.transform(spoken.cues(t), cue_text), ";")),
    [
        ("(笑)こんにちは", "こんにちは|laugh:laugh:0:-"),
        ("a【間 1.5秒】b(pause 800ms)", "ab|pause:pause:1:1.5;pause:pause:10:0.8"),
        ("plain", "plain|"),
        ("（長い間）x", "x|pause:pause:0:0.8"),
        ("go(left door){耳元}", "go|stage_direction:left door:2:-;spatial:ear_close:13:-"),
    ],
)
cases(
    "spoken_korean",
    lambda t: F.concat(spoken.korean(t)["text"], F.lit("|"), F.array_join(spoken.korean(t)["flags"], ",")),
    [
        ("OK, GPT-SoVITS 12345개", "오케이, 지피티 소비츠 만이천삼백사십오개|normalized_latin_token,normalized_numeric_token,normalized_tts_text"),
        ("안녕하세요", "안녕하세요|"),
        ("(笑)", "|normalized_tts_text,tts_text_empty"),
        ("3.05% 할인!!", "삼점영오 퍼센트 할인!|normalized_numeric_token,normalized_symbol_token,normalized_tts_text"),
        ("가♡나😀다 100,000", "가나다 백, 영영영|normalized_numeric_token,normalized_tts_text"),
        ("가 " * 50 + "끝.", " ".join(["가"] * 44) + ", " + " ".join(["가"] * 6) + " 끝.|split_long_korean_clause,normalized_tts_text"),
    ],
)
cases(
    "spoken_japanese",
    lambda t: F.concat(spoken.spoken(t, F.lit("ja"))["text"], F.lit("|"), F.array_join(spoken.spoken(t, F.lit("ja"))["flags"], ",")),
    [
        ("ASMRを3分 10秒", "エーエスエムアールをさんぷん じゅうびょう|normalized_tts_text"),
        ("42分", "42分|unhandled_numeric_token"),
        ("はい. どうぞ!!", "はい。どうぞ！|normalized_tts_text"),
        ("", "|tts_text_empty"),
    ],
)
cases("korean_marks", spoken.korean_punctuation, [("가 ,나。。다", "가, 나. 다"), ("....가", "… 가"), ("가....", "가…"), ("뭐?? 응!", "뭐? 응!"), ("가,나", "가, 나")])
cases("long_clauses", lambda t: spoken.split_clauses(t, 5)["text"], [("하나 둘 셋 넷 다섯.", "하나 둘 셋 넷, 다섯."), ("짧다. 예!", "짧다. 예!"), ("가나다라마바사", "가나다라마바사"), ("한 문장 더 있다! 끝", "한 문장 더, 있다! 끝")])
cases("kana_readings", lambda t: F.concat(spoken.kana_reading(t)["text"], F.lit("|"), F.array_join(spoken.kana_reading(t)["flags"], ",")), [("カタカナ", "かたかな|normalized_japanese_kana_text"), ("ひらがな", "ひらがな|"), ("漢字", "漢字|remaining_non_kana_japanese_text"), (" ", "|japanese_kana_text_empty")])
cases("cut_off_texts", lambda t: F.concat(spoken.cut_off(t).cast("string"), F.lit("|"), spoken.repair_cut_off(t)["text"]), [("가자,", "true|가자..."), ("이제 그리고", "true|이제 그리고..."), ("다음 장", "true|다음 장..."), ("끝났어요.", "false|끝났어요."), (" ", "false|")])
cases(
    "spoken_text_policy",
    lambda t: F.array_join(spoken.text_policy(t, F.lit("kr"), F.lit("元の文")), ","),
    [
        ("안녕하세요.", ""),
        ("", "korean_tts_text_empty,korean_tts_missing_hangul"),
        ("가 あ (x) 1", "korean_tts_contains_kana,korean_tts_contains_stage_direction,korean_tts_contains_latin,korean_tts_contains_digit,korean_tts_contains_pronunciation_symbol"),
        ("元の文", "korean_tts_contains_kana,korean_tts_contains_pronunciation_symbol,korean_tts_matches_source_japanese,korean_tts_missing_hangul,korean_tts_hangul_ratio_too_low"),
        ("가" * 45, "korean_tts_long_clause_without_pause"),
        ("가자,", "korean_tts_suspicious_truncated_sentence"),
    ],
)
cases("colloquial_korean", spoken.colloquial, [("이것은 문장입니다.", "이건 문장이에요."), ("준비입니다", "준비예요"), ("저는 시작하겠습니다", "전 시작할게요"), ("무엇이 있습니까?", "뭐가 있어요?"), (" abc ", "abc"), ("저는요", "저는요")])
cases("sanitized_korean", spoken.sanitized, [("TTS 10개(둘)", "티티에스 십개 둘"), ("2025년", "이천이십오년"), ("007", "영 영 칠"), ("12345", "일 이 삼 사 오"), ("ok: 0", "오케이 영")])
cases("fitted_korean", lambda t: spoken.fitted(t, F.lit(6)), [("반드시 갑니다", "반드시 갑니다"), ("반드시 합니다요", "꼭 합니다요"), ("하나 둘 셋 넷 다섯 여섯", "하나 둘 셋 넷"), ("가나다라마바사아", "가나다라마바사아")])
cases("salvaged_korean", lambda t: spoken.salvaged(F.get(F.split(t, "/"), 0), F.get(F.split(t, "/"), 1), F.lit(6)), [("하나 둘 셋/x", "하나 둘 셋"), ("가나다라마바사아자/짧다", "짧다"), ("あ/가", None), ("10개/x", "십개")])
cases("rewritten_durations", lambda t: spoken.rewritten_for_duration(t, F.lit(2.0))["text"], [("가나다라마바사아", "가나다라마바사아"), ("짧다.", "짧다... 괜찮아요."), ("하나 둘 셋 넷 다섯 여섯 일곱", "하나 둘 셋 넷 다섯")])
cases("backend_names", spoken.backend_name, [(" GPT-SoVITS ", "gpt_sovits"), ("Qwen", "qwen"), ("gpt-sovits-countdown-renderer", "gpt_sovits")])
cases("hangul_syllables", spoken.hangul_units, [("１２ 가a나!", "일이가나"), ("abc", ""), ("3번", "삼번")])
cases("source_number_texts", lambda t: joined(counting.source_values(t)), [("3, 2, 1", "3,2,1"), ("十、九、八", "10,9,8"), ("さん に いち", "3,2,1"), ("サン、ニジュウ", None), ("さんにん", None), ("1.5", None), ("二十一 ゼロ", "21,0"), ("１０…９", "10,9"), ("abc", None)])
cases("embedded_countdowns", lambda t: F.array_join(F.transform(counting.embedded_countdown(t), lambda m: F.concat(m["value"].cast("string"), F.lit("="), m["raw"])), ","), [("あと3つ、2つ、1つ", "3=3,2=2,1=1"), ("三 then 二 then 一", "3=三,2=二,1=一"), ("1 2 3", None), ("none", None)])
cases("korean_number_values", lambda t: joined(counting.korean_values(t)), [("하나둘셋 넷", "1,2,3,4"), ("일 이 삼", "1,2,3"), ("123 공", "1,2,3,0"), ("열하나, 구십구", "11,99"), ("하나님", ""), ("", "")])
cases("periodized_counts", lambda t: counting.periodized(t)["text"], [("시작 3, 2, 1 끝", "시작 셋. 둘. 하나. 끝"), ("열, 아홉, 여덟. 말이에요.", "열. 아홉. 여덟."), ("하나 둘", "하나 둘"), ("삼 이 일! 다시 넷, 셋, 둘", "셋. 둘. 하나. 다시 넷. 셋. 둘.")])
