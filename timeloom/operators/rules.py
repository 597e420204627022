"""Gates with conditions of their own: noise and runaway texts, review of recognised text, audio candidates, training clips, translations.

Every gate is a column expression: an array of reasons in a fixed order, or the first reason. A null measure fails no gate unless the gate asks for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeloom.functions import numeric, text
from timeloom.functions.counting import repair_hits, source_values
from timeloom.functions.spoken import let, spoken_length
from timeloom.operators.gates import pattern_hits
from timeloom.operators.reasons import first_reason, reasons

# Characters of breaths and drawn-out sounds, marks that go with them, and cues of a count.
SOUND_CHARS = "ぁあぃいぅうぇえぉおァアィイゥウェエォオんンっッはハひヒふフへヘほホゃゅょャュョーｰ〜～"
SOUND_MARKS = "ぁぃぅぇぉァィゥェォっッーｰ〜～"
SOUND_PUNCTUATION = "…♪♡❤・ーｰ〜～"
COUNT_CUES = ["あと", "カウント", "count", "COUNT"]
MARKS = "[\\s　、。,.，．!！?？…・♪♡❤]+"


def fixed(c: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def above(value: Column, most: float, name: str) -> tuple[Column, Column]:
    return value > most, F.concat(F.lit(f"{name}_above_max:"), fixed(value), F.lit(f">{most:.3f}"))


def below(value: Column, least: float, name: str) -> tuple[Column, Column]:
    return value < least, F.concat(F.lit(f"{name}_below_min:"), fixed(value), F.lit(f"<{least:.3f}"))


def dominant_char(compact: Column) -> Column:
    return text.dominant_run(compact, 25, 0.55, 16)


def dominant_ngram(compact: Column, n_from: int = 2, n_to: int = 5, repeats: int = 8, cover: float = 0.78, rest: int = 12, least: int = 30) -> Column:
    """A unit of 2 to 5 characters (not all alike) that follows itself ``repeats`` times and makes up ``cover`` of the text, or leaves at most ``rest`` of it."""
    length = F.length(compact)

    def found(n: int) -> Column:
        runs = F.regexp_extract_all(compact, F.lit(f"(?s)((.{{{n}}})\\2{{{repeats - 1},}})"), F.lit(1))
        mixed = F.filter(runs, lambda r: ~F.regexp_like(F.substring(r, 1, n), F.lit("(?s)^(.)\\1*$")))
        return F.exists(mixed, lambda r: (F.length(r) >= cover * length) | (length - F.length(r) <= rest))

    return (length >= least) & reduce(lambda a, b: a | b, map(found, range(n_from, n_to + 1)))


def only_numbers(t: Column) -> Column:
    return source_values(t).isNotNull() | F.regexp_like(text.strip(t), F.lit("^[0-9０-９\\s　,，、.．。・]+$"))


def is_noise(t: Column, seconds: Column, sparse: list[str]) -> Column:
    """Breath and other sound written down: marks only, known short sounds over a long time, a dominant repetition, or nothing but sound characters with a drawn-out one."""
    compact = F.regexp_replace(t, MARKS, "")

    def judged(c: Column) -> Column:
        sounds = F.regexp_like(c, F.lit(f"^[{SOUND_CHARS}]+$"))
        marked = F.regexp_like(c, F.lit(f"(.)\\1{{2,}}|[{SOUND_MARKS}]"))
        short = (F.length(c) <= 24) | ((seconds >= 6) & (F.length(c) / F.greatest(F.lit(0.001), seconds) < 1))
        marks_only = (seconds >= 2) & F.regexp_like(t, F.lit(f"[{SOUND_PUNCTUATION}]"))
        return F.when(c == "", marks_only).otherwise(((seconds >= 6) & c.isin(sparse)) | dominant_char(c) | dominant_ngram(c) | (sounds & marked & short))

    return F.coalesce(~only_numbers(t) & let(compact, judged), F.lit(False))


def numeric_runaway(t: Column, seconds: Column, long: float) -> Column:
    """A text of numbers only that lasts long, or has six or more with one of them four times."""
    most = lambda v: F.array_max(F.transform(v, lambda x: F.size(F.filter(v, lambda y: y == x))))
    return F.coalesce(let(source_values(t), lambda v: v.isNotNull() & ((seconds >= long) | ((F.size(v) >= 6) & (most(v) >= 4)))), F.lit(False))


def anomaly(t: Column, seconds: Column) -> Column:
    """The first of: one character on and on, numbers on and on, more text than can be said; null if none."""
    s = text.strip(t)
    compact = F.regexp_replace(s, "\\s+", "")
    values = F.regexp_extract_all(s, F.lit("\\d+"), F.lit(0))
    digits = F.transform(values, lambda v: F.regexp_replace(v, "^0+(?=\\d)", ""))
    repeat = F.coalesce(F.array_max(F.transform(digits, lambda x: F.size(F.filter(digits, lambda y: y == x)))), F.lit(0))
    cue = reduce(lambda a, b: a | b, [s.contains(c) for c in COUNT_CUES])
    small = F.forall(digits, lambda d: F.length(d) <= 9)
    steady = numeric.is_monotonic(F.transform(digits, lambda d: F.when(F.length(d) <= 9, d).cast("long")))
    counted = (F.size(values) >= 6) & ((repeat >= 4) | (cue & ~(small & steady)))
    dense = (F.length(s) >= 80) & (F.size(values) >= 32) & (F.length(F.regexp_replace(s, "[^\\d,，、.．・ \\t\\n\\r]", "")) >= 0.85 * F.length(s))
    return first_reason(((F.length(compact) >= 30) & F.regexp_like(compact, F.lit("(.)\\1{24,}")), "degenerate_repetition"), (counted | dense, "numeric_runaway"), ((F.length(compact) >= 80) & (F.length(s) / F.greatest(F.lit(0.001), seconds) >= 18), "excessive_text_density"))


def needs_repair(t: Column, seconds: Column, confidence: Column, patterns: list[str], least_confidence: float, long: float, least_density: float) -> Column:
    """Ordered: noise no; numbers on and on yes; other numbers no; a suspicious pattern, low confidence, or long with hardly any text yes."""
    s = text.strip(t)
    sparse = (seconds >= long) & (text.density(t, seconds) < least_density)
    yes = (F.size(pattern_hits(s, patterns)) > 0) | F.coalesce(confidence < least_confidence, F.lit(False)) | sparse
    return F.when(s == "", False).when(is_noise(t, seconds, []), False).when(numeric_runaway(t, seconds, long), True).when(only_numbers(t), False).otherwise(yes)


def drop_reason(t: Column, seconds: Column, cfg_patterns: list[str]) -> Column:
    """Why a row is dropped, by priority; null if it stays."""
    return first_reason((text.strip(t) == "", "empty_text"), (is_noise(t, seconds, []), "non_speech_texture"), (anomaly(t, seconds).isNotNull(), "anomalous_text"), (F.size(pattern_hits(t, cfg_patterns)) > 0, "suspicious_pattern"))


def is_term_list(t: Column, terms: list[str]) -> Column:
    """Three or more terms that make up all pieces of a text, or 65 % of its characters (a term within a longer one met does not count)."""
    compact = F.regexp_replace(t, "\\s+", "")
    pieces = F.filter(F.split(t, "[\\s　、。,，・/|;:]+"), lambda p: p != "")
    exact = F.filter(pieces, lambda p: p.isin(terms))
    ordered = F.array(*map(F.lit, sorted(terms, key=lambda x: (-len(x), x))))
    start = F.slice(F.array(F.lit("")), 1, 0)
    met = lambda c: F.aggregate(ordered, start, lambda a, x: F.when(c.contains(x) & ~F.exists(a, lambda y: F.contains(y, x)), F.concat(a, F.array(x))).otherwise(a))
    covered = let(compact, lambda c: let(met(c), lambda m: (F.size(m) >= 3) & (F.aggregate(m, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.lit(1), F.length(c)) >= 0.65)))
    return (compact != "") & (F.length(compact) <= 64) & (((F.size(exact) >= 3) & (F.size(exact) == F.size(pieces))) | covered)


def audio_candidate(exists: Column, error: Column, rate: Column, channels: Column, seconds: Column, reference: Column, rms: Column, peak: Column, clipping: Column, want: tuple[int, int] = (16000, 1), tolerance: float = 0.02, least_rms: float = -55.0, least_peak: float = -45.0) -> Column:
    """Why an audio candidate is not used: missing or unreadable, else format, length, level and clipping."""
    off = F.abs(seconds - reference)
    zero = lambda c, d: F.coalesce(c, F.lit(d))
    checks = reasons(
        (~((rate == want[0]) & (channels == want[1])), "format_mismatch"),
        (zero(seconds, 0.0) <= 0.05, "empty_or_too_short"),
        ((reference > 0) & (seconds > 0) & (off > 1) & (off / F.when(reference > 0, reference) > tolerance), F.concat(F.lit("duration_mismatch:"), fixed(seconds), F.lit("s_vs_"), fixed(reference), F.lit("s"))),
        ((zero(rms, -120.0) <= least_rms) | (zero(peak, -120.0) <= least_peak), F.concat(F.lit("too_quiet:rms="), fixed(zero(rms, -120.0), 1), F.lit("dbfs,peak="), fixed(zero(peak, -120.0), 1), F.lit("dbfs"))),
        (zero(clipping, 0.0) > 0.02, F.concat(F.lit("clipping:"), fixed(zero(clipping, 0.0), 4))),
    )
    return F.when(~zero(exists, False), F.array(F.lit("missing"))).when(error.isNotNull(), F.array(F.concat(F.lit("read_error:"), error))).otherwise(checks)


def voice_candidate(manual: Column, speaker: Column, speakers: Column, script: Column, language: Column, want_language: str, audio: Column, score: Column, least_score: float, bleed: Column, most_bleed: float) -> Column:
    """Why a clip is no training material: reasons given by hand first, then speaker, script, language, audio, quality and bleed."""
    return F.array_distinct(
        F.concat(
            F.coalesce(manual, F.slice(F.array(F.lit("")), 1, 0)),
            reasons(
                (F.coalesce(speaker, F.lit("")) == "", "missing_speaker_id"),
                (speakers != 1, F.concat(F.lit("speaker_count_not_one:"), speakers.cast("string"))),
                (text.strip(F.coalesce(script, F.lit(""))) == "", "missing_source_script"),
                ((text.strip(F.coalesce(script, F.lit(""))) != "") & (language != want_language), F.concat(F.lit("source_language_mismatch:"), language)),
                (F.coalesce(audio, F.lit("")) == "", "missing_audio_for_mix"),
                (score < least_score, F.concat(F.lit("quality_score_below_min:"), fixed(score), F.lit(f"<{least_score:.3f}"))),
                above(bleed, most_bleed, "background_bleed_db"),
            ),
        )
    )


def clip_length(seconds: Column, least: float, most: float) -> Column:
    return reasons(below(seconds, least, "duration"), above(seconds, most, "duration"))


def speaking_rate(t: Column, seconds: Column, most: float | None) -> Column:
    """Too many characters a second; without a limit nothing."""
    rate = F.when(seconds > 0, F.length(F.regexp_replace(t, "[\\s　]", "")) / F.when(seconds > 0, seconds)).otherwise(0.0)
    return reasons(above(rate, most, "source_chars_per_sec")) if most else F.slice(F.array(F.lit("")), 1, 0)


def training_policy(preset: str, seconds: Column, score: Column, snr: Column, bleed: Column, side: Column) -> Column:
    """Limits of the strict preset; any other has none."""
    if preset != "strict":
        return F.slice(F.array(F.lit("")), 1, 0)
    strict = (score < 0.8, F.concat(F.lit("rvc_train_quality_score_below_strict_min:"), fixed(score), F.lit("<0.800")))
    return reasons(above(seconds, 12.0, "rvc_train_duration_sec"), strict, below(snr, 18.0, "rvc_train_estimated_snr_db"), above(bleed, -30.0, "rvc_train_background_bleed_db"), above(side, -12.0, "rvc_train_side_to_mid_db"))


def reference_clip(blocked: Column, decision: Column, exclude: Column, eligible: Column, clean: Column, tags: Column) -> Column:
    """Why a clip is no voice reference, from the quality gate, the training flags and its effect tags."""
    d = F.lower(F.trim(decision))
    effects = F.filter(F.transform(F.coalesce(tags, F.slice(F.array(F.lit("")), 1, 0)), lambda t: F.lower(F.trim(t))), lambda t: ~t.isin("", "none", "clean", "natural", "no_effect"))
    first = reasons((blocked, "asr_quality_gate_tts_blocked"), (d.isin("block", "blocked", "reject", "rejected", "manual_review"), F.concat(F.lit("asr_quality_gate:"), d)), (exclude, "voice_training_exclude"), (~eligible, "voice_training_ineligible"), (~clean, "voice_training_unclean"))
    return F.array_distinct(F.concat(first, F.transform(effects, lambda t: F.concat(F.lit("voice_training_effect_tag:"), t))))


def review_reasons(t: Column, seconds: Column, confidence: Column, patterns: list[str], terms: list[str], least_confidence: float = 0.78) -> Column:
    """Why a recognised text is to be reviewed. Noise needs no review, and a text made of prompt terms has no other reason."""
    s = text.strip(F.coalesce(t, F.lit("")))
    hits = pattern_hits(s, patterns)
    odd = anomaly(s, seconds)
    compact = F.regexp_replace(s, "[\\s　、。,.，．!！?？…・♪♡❤（）()\\[\\]「」『』]+", "")
    sparse = ((seconds >= 12) | ((seconds >= 8) & (F.length(compact) <= 2))) & (F.length(s) / F.greatest(F.lit(0.001), seconds) < 1)
    found = reasons(
        (F.size(hits) > 0, F.concat(F.lit("asr_suspicious_pattern:"), F.array_join(F.slice(hits, 1, 5), ","))),
        (odd.isNotNull(), F.concat(F.lit("asr_"), odd)),
        (confidence < least_confidence, F.concat(F.lit("asr_low_confidence:"), fixed(confidence))),
        (sparse, "asr_sparse_text_density"),
    )
    none = F.slice(found, 1, 0)
    return F.when(s == "", F.array(F.lit("missing_asr_text"))).when(is_noise(s, seconds, []), none).when(is_term_list(s, terms), F.array(F.lit("asr_prompt_or_hallucination_leak"))).otherwise(found)


def repair_target(status: Column, repairable: Column, has_audio: Column, has_script: Column, recoverable: Column) -> Column:
    """Whether a row is taken up by automatic repair."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(status == "needs_regeneration", True)
        .when(status == "needs_manual_review", yes(repairable))
        .when(status == "failed", yes(repairable) | yes(has_audio) | ~yes(has_script))
        .when(status == "quarantined", yes(recoverable))
        .otherwise(False)
    )


def text_key(t: Column, replacements: list[tuple[str, str]]) -> Column:
    """The key under which two recognised texts count as equal: replacements made, countdowns mended, marks and spaces out."""
    return text.compact(repair_hits(text.replace_all(t, replacements))["text"])


def repeat_compact(t: Column) -> Column:
    return F.regexp_replace(t, "[\\s、。，,.!?！？…]+", "")


def has_repeated_phrase(t: Column, n: int = 8) -> Column:
    """A run of ``n`` characters that comes twice and says something: two ideographs."""

    def found(c: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
        telling = F.filter(grams, lambda g: F.length(F.regexp_replace(g, "[^㐀-䶿一-鿿]", "")) >= 2)
        return (F.length(c) >= 2 * n) & (F.size(telling) > F.size(F.array_distinct(telling)))

    return let(repeat_compact(t), found)


def omits_repetition(source: Column, literal: Column, natural: Column) -> Column:
    """The source repeats a phrase, and the natural translation is shorter than 75 % of a long literal one."""
    a, b = F.length(repeat_compact(literal)), F.length(repeat_compact(natural))
    return has_repeated_phrase(source) & (a >= 40) & (b >= 1) & (b / F.greatest(a, F.lit(1)) < 0.75)


def translation_errors(ident: Column, source: Column, out: Column, seconds: Column, field: str = "ko_natural") -> Column:
    """What is wrong with a translation, as messages with the row's id; nothing for an empty source."""
    s, t = text.strip(source), text.strip(out)
    has = lambda c, p: F.regexp_like(c, F.lit(p))
    say = lambda m: F.concat(ident.cast("string"), F.lit(f": {field} {m}"))
    # letters and digits of the source stand for beats, ideographs for two
    beats = F.length(F.regexp_replace(F.regexp_replace(s, "[^\\p{L}\\p{N}ー]", ""), "[ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ]", "")) + F.length(F.regexp_replace(s, "[^㐀-䶿一-鿿]", ""))
    most = F.greatest(F.when(beats > 0, beats).otherwise(F.greatest(F.lit(4), F.floor(seconds * 4))), F.lit(6)).cast("int")
    long = spoken_length(t) > most
    checks = [
        (has(t, "[\\u3040-\\u30ff]"), say("still contains Japanese kana")),
        (has(t, "[㐀-䶿一-鿿]"), say("still contains untranslated CJK characters")),
        (has(t, "[A-Za-z]"), say("contains Latin letters; spell acronyms in Hangul")),
        (has(t, "\\d"), say("contains raw digits; spell numbers in Korean")),
        (long, F.concat(say("exceeds Korean TTS max speech chars "), spoken_length(t).cast("string"), F.lit(">"), most.cast("string"), F.lit(" for "), fixed(seconds), F.lit("s"))),
        (~has(t, "[가-힣]"), say("has no Hangul for Japanese source text")),
        ((F.length(s) >= 30) & (F.length(t) / F.greatest(F.length(s), F.lit(1)) < 0.25) & long, say("is too short for the source text")),
    ]
    found = reasons(*checks)
    return F.when(s == "", F.slice(found, 1, 0)).when(t == "", F.array(say("is empty"))).otherwise(found)


def translation_issues(source: Column, literal: Column, natural: Column, numeric_source: Column, lexicon: list[tuple[str, list[str]]]) -> Column:
    """Issue codes of a translation. ``lexicon``: a word of the source with words that its translation must not have."""
    n = text.strip(natural)
    both = F.concat_ws(" ", text.strip(literal), n)
    wrong = F.lit(False)
    for word, bad in lexicon:
        wrong = wrong | (source.contains(word) & reduce(lambda a, b: a | b, [both.contains(x) for x in bad]))
    has = lambda p: F.regexp_like(n, F.lit(p))
    found = reasons(
        (n == "", "empty_translation"),
        (numeric_source & has("\\d"), "raw_digit"),
        (has("[\\u3040-\\u30ff]"), "japanese_kana"),
        (has("[㐀-䶿一-鿿]"), "untranslated_cjk"),
        (has("[A-Za-z]"), "latin"),
        (wrong, "domain_mistranslation"),
        (omits_repetition(source, literal, natural), "natural_repetition_omission"),
    )
    return F.when(natural.isNull(), F.array(F.lit("missing_translation"))).otherwise(found)


def back_check(source: Column, out: Column, source_patterns: list[str], out_patterns: list[str]) -> Column:
    """struct<source_hits, out_hits, reasons, severity>: patterns of known risk found in source and translation; null for none. Both sides at once are severe."""
    found = lambda c, ps: F.array_compact(F.array(*[F.when(c.contains(p), F.lit(p)) for p in ps]))
    a, b = found(source, source_patterns), found(out, out_patterns)
    why = reasons((F.size(a) > 0, "source_text_contains_known_asr_risk"), (F.size(b) > 0, "korean_translation_contains_asr_smell"))
    severity = F.when((F.size(a) > 0) & (F.size(b) > 0), "severe").otherwise("warning")
    return F.when(F.size(why) > 0, F.struct(a.alias("source_hits"), b.alias("out_hits"), why.alias("reasons"), severity.alias("severity")))


def accepted_translation(issues: Column, severity: Column, warnings: Column, literal: Column, natural: Column, most_chars: Column, warn_only: bool = True) -> Column:
    """struct<status, accepted, text, rejected, warnings>: any issue or a severe back-check sends a row to review. An omitted repetition as the only reason is a warning under that
    policy, and the literal text is taken where it fits."""
    rejected = F.concat(F.array_distinct(issues), F.when(severity == "severe", F.array(F.lit("severe_translation_smell"))).otherwise(F.slice(issues, 1, 0)))
    only = F.lit(warn_only) & (rejected == F.array(F.lit("natural_repetition_omission")))
    lit = text.strip(literal)
    fallback = only & (lit != "") & (lit != text.strip(natural)) & (spoken_length(lit) <= most_chars)
    ok = only | (F.size(rejected) == 0)
    warned = F.array_distinct(F.concat(warnings, F.when(only, rejected).otherwise(F.slice(rejected, 1, 0))))
    return F.struct(F.when(ok, "translated").otherwise("needs_manual_review").alias("status"), ok.alias("accepted"), F.when(fallback, lit).otherwise(natural).alias("text"), F.when(ok, F.slice(rejected, 1, 0)).otherwise(rejected).alias("rejected"), warned.alias("warnings"))


def candidate_score(original: Column, seconds: Column, confidence: Column, candidate: Column, c_seconds: Column, c_confidence: Column, leaked: Column, patterns: list[str]) -> Column:
    """struct<accepted, score, reason>: outcomes that rule a repaired text out have a fixed low score; else improvements are added up."""
    o, c = text.strip(original), text.strip(candidate)
    length = F.greatest(F.lit(0.001), c_seconds)
    odd = anomaly(c, length)
    bad = lambda t: F.size(pattern_hits(t, patterns)) > 0
    cleaner = bad(o) & ~bad(c)
    better = cleaner | (F.coalesce(c_confidence - confidence, F.lit(0.0)) > 0)
    step = numeric.clamp(F.length(c) / length - F.length(o) / F.greatest(F.lit(0.001), seconds), -2.0, 2.0)
    ratio = F.length(c) / F.greatest(F.lit(1), F.length(o))
    score = F.when(cleaner, 2.0).otherwise(0.0) + F.coalesce(c_confidence - confidence, F.lit(0.0)) + step * 0.25 + F.when(ratio.between(0.6, 1.8), 0.5).otherwise(-0.5)
    out = lambda ok, s, why: F.struct(F.lit(ok).alias("accepted"), s.cast("double").alias("score"), why.alias("reason"))
    return (
        F.when(c == "", out(False, F.lit(-100), F.lit("empty_candidate")))
        .when(leaked, out(False, F.lit(-90), F.lit("prompt_or_hallucination_leak")))
        .when(odd.isNotNull(), out(False, F.lit(-80), odd))
        .when(bad(c), out(False, F.lit(-70), F.lit("fallback_still_suspicious")))
        .when(~better, out(False, F.lit(-10), F.lit("not_confidently_better_than_original")))
        .otherwise(out(True, score, F.lit("accepted")))
    )


# Effects in their order, and other names of them.
EFFECTS = ["telephone", "radio", "robot", "distortion", "reverb", "echo"]
ALIASES = {"phone": "telephone", "telephone_filter": "telephone", "telephone_voice": "telephone", "radio_voice": "radio", "walkie_talkie": "radio", "robot_voice": "robot", "robotic": "robot", "voice_effect": "effect", "effected_voice": "effect"}


def token(value: Column) -> Column:
    return F.translate(F.lower(F.trim(value)), "- ", "__")


def tokens(*lists: Column) -> Column:
    """Normalised tokens of several arrays, in order; empty ones and nulls are left out."""
    none = F.slice(F.array(F.lit("")), 1, 0)
    every = F.concat(*[F.coalesce(x, none) for x in lists])
    return F.filter(F.transform(F.array_compact(every), token), lambda t: t != "")


def effect_tags(*lists: Column) -> Column:
    """The known effects among some tags, by their usual names and in their usual order."""
    from timeloom.functions.spoken import look_up

    named = F.transform(tokens(*lists), lambda t: F.coalesce(look_up(ALIASES, t), t))
    return F.array_intersect(F.array(*map(F.lit, EFFECTS)), named)


EVENT = "struct<tag:string,name:string,target:string,start_sec:double,end_sec:double,intensity:double,confidence:double>"


def effect_events(events: Column, seconds: Column) -> Column:
    """Events with a known tag, within the row's time: no target is the voice, an end at or before the start is the row's end."""
    length = F.greatest(F.lit(0.0), seconds)
    clamp = lambda c, d, hi: F.greatest(F.lit(0.0), F.least(hi, F.coalesce(c, d)))

    def one(e: Column) -> Column:
        start, end = clamp(e["start_sec"], F.lit(0.0), length), clamp(e["end_sec"], length, length)
        target = token(F.coalesce(e["target"], F.lit("voice")))
        return F.struct(
            token(F.coalesce(e["tag"], e["name"])).alias("tag"),
            F.when(target.isin("voice", "background", "mixed"), target).otherwise("voice").alias("target"),
            F.round(start, 6).alias("start_sec"),
            F.round(F.when(end <= start, length).otherwise(end), 6).alias("end_sec"),
            clamp(e["intensity"], F.lit(1.0), F.lit(1.0)).alias("intensity"),
            clamp(e["confidence"], F.lit(0.0), F.lit(1.0)).alias("confidence"),
        )

    return F.filter(F.transform(F.array_compact(events), one), lambda e: e["tag"].isin(EFFECTS))


def style_response(json: Column) -> Column:
    """struct<style, tags, pan, keep, confidence, eligible> of a loose answer: strict JSON with defaults, aliases and limits. Unreadable JSON gives the defaults."""
    got = F.from_json(json, "spatial_style string, style_tags array<string>, estimated_pan string, keep_original_texture string, confidence string, voice_training struct<eligible: string>")
    style = token(got["spatial_style"])
    known = F.when(style.isin("left", "left_ear", "ear_left"), "ear_left").when(style.isin("right", "right_ear", "ear_right"), "ear_right").when(style.isin("near", "ear_close", "close"), "ear_close")
    flag = lambda c, d: F.when(F.lower(c).isin("true", "yes", "1"), True).when(F.lower(c).isin("false", "no", "0"), False).otherwise(d)
    pan = numeric.clamp(F.coalesce(F.expr("cast(null as double)"), F.try_to_number(got["estimated_pan"], F.lit("S999.999")).cast("double")), -1.0, 1.0)
    return F.struct(
        F.coalesce(known, F.lit("center")).alias("style"),
        tokens(got["style_tags"]).alias("tags"),
        F.coalesce(pan, F.lit(0.0)).alias("pan"),
        flag(got["keep_original_texture"], True).alias("keep"),
        F.coalesce(text.confidence(got["confidence"]), F.lit(0.0)).alias("confidence"),
        flag(got["voice_training"]["eligible"], True).alias("eligible"),
    )


def pronunciation_check(expected: Column, transcript: Column, passes: float = 0.82, warns: float = 0.62, most_ratio: float = 1.8, most_extra: int = 1) -> Column:
    """struct<coverage, gate, issues> of a transcript against what was to be said, by Hangul syllables: how much of it is heard in order, and whether more is heard than that."""
    from timeloom.functions.kernel import lcs_length
    from timeloom.functions.spoken import hangul_units

    def judged(e: Column, o: Column, matched: Column) -> Column:
        n, m = F.length(e), F.length(o)
        coverage = F.try_divide(matched, n)
        long = (m - n > most_extra) | (F.try_divide(m, n) > most_ratio)
        suffix = (n == 1) & o.startswith(e) & (m > n)
        overrun = (m > n) & F.when(n == 1, o.startswith(e)).otherwise(o.startswith(F.concat(e, e)) | (F.substring(F.repeat(e, F.floor(F.try_divide(m, n)).cast("int") + 2), F.lit(1), m) == o))
        enough = coverage >= warns
        gate = F.when(n == 0, "unavailable").when(m == 0, "fail").when((long | suffix) & enough, "fail").when(coverage >= passes, "pass").when(enough, "warn").otherwise("fail")
        loud = F.array_compact(F.array(F.when(long, "observed_pronunciation_too_long"), F.when(long & overrun, "repetition_overrun"), F.when(suffix, "suffix_contamination")))
        one = lambda name: F.array(F.lit(name))
        issues = F.when(n == 0, one("empty_expected_text")).when(m == 0, one("empty_transcript")).when((long | suffix) & enough, loud).when(coverage >= passes, F.slice(one(""), 1, 0)).when(enough, one("low_pronunciation_coverage")).otherwise(one("pronunciation_coverage_below_threshold"))
        return F.struct(F.when(n == 0, 1.0).when(m == 0, 0.0).otherwise(coverage).alias("coverage"), gate.alias("gate"), issues.alias("issues"))

    e, o = hangul_units(expected), hangul_units(transcript)
    # short numerals are often heard as a like-sounding syllable
    alias = F.when((e == "일") & (o == "예"), "일").when((e == "육") & o.isin("유", "류"), "육").otherwise(o)
    return judged(e, alias, lcs_length(F.split(e, ""), F.split(alias, "")))
