"""Gates with conditions of their own, on lines and on measures of lineitem."""

from pyspark.sql import functions as F


from timeloom.operators import rules
from timeloom.plans.case_queries import cases
from timeloom.plans.catalog import query
from timeloom.sources.tables import load


cases("noise_texts", lambda t: rules.is_noise(t, F.lit(6.5), ["あ"]).cast("string"), [("あぁぁ…", "true"), ("…♡", "true"), ("あ", "true"), ("こんにちは", "false"), ("3, 2, 1", "false"), ("ぴちゃ" * 12, "true"), ("a" * 40, "true")])
cases("dominant_ngrams", lambda t: rules.dominant_ngram(t).cast("string"), [("ab" * 20, "true"), ("ab" * 12 + "cdefghijklmnop", "false"), ("aaaa" * 10, "false"), ("abcde" * 8 + "xyz", "true"), ("ab" * 5, "false")])
cases("runaway_numbers", lambda t: rules.numeric_runaway(t, F.lit(3.0), 12.0).cast("string"), [("1 1 1 1 2 3", "true"), ("5 4 3 2 1 0", "false"), ("one", "false"), ("7 7 7 7", "false")])
cases("text_anomalies", lambda t: rules.anomaly(t, F.lit(2.0)), [("x" * 30, "degenerate_repetition"), ("1 2 1 2 1 2 1 2", "numeric_runaway"), ("あと 9 7 5 3 1 2", "numeric_runaway"), ("あと 6 5 4 3 2 1", None), ("abcd efgh " * 11, "excessive_text_density"), ("fine", None)])
cases("repair_needs", lambda t: rules.needs_repair(t, F.lit(20.0), F.lit(0.9), ["字幕"], 0.5, 12.0, 1.0).cast("string"), [("", "false"), ("…", "false"), ("3 2 1", "true"), ("字幕 by x", "true"), ("a long enough line of text", "false"), ("short", "true")])
cases("drop_reasons", lambda t: rules.drop_reason(t, F.lit(3.0), ["字幕"]), [(" ", "empty_text"), ("んんっ", "non_speech_texture"), ("y" * 31, "non_speech_texture"), ("字幕", "suspicious_pattern"), ("ok", None)])
cases("term_lists", lambda t: rules.is_term_list(t, ["alpha", "beta", "gamma", "alphabet"]).cast("string"), [("alpha, beta, gamma", "true"), ("alphabet beta gamma", "true"), ("alpha beta", "false"), ("alphabetagammaxx", "true"), ("the alpha and the beta met gamma in town", "false")])
cases("review_reasons", lambda t: F.array_join(rules.review_reasons(t, F.lit(13.0), F.lit(0.5), ["字幕", "("], ["alpha", "beta", "gamma"]), ";"), [("", "missing_asr_text"), ("んんっ", ""), ("alpha beta gamma", "asr_prompt_or_hallucination_leak"), ("字幕 (x", "asr_suspicious_pattern:字幕,(;asr_low_confidence:0.500;asr_sparse_text_density"), ("a line that is long enough", "asr_low_confidence:0.500")])
cases("text_keys", lambda t: rules.text_key(t, [("cat", "dog")]), [("The cat, sat.", "Thedogsat"), ("9 8 7 1 5", "98765"), ("", "")])
cases("repeated_phrases", lambda t: rules.has_repeated_phrase(t).cast("string"), [("今日は良い天気です。今日は良い天気です", "true"), ("abcdefghabcdefgh", "false"), ("今日は", "false")])
cases("omitted_repetitions", lambda t: rules.omits_repetition(F.lit("今日は良い天気です。今日は良い天気です"), F.lit("가" * 40), t).cast("string"), [("가" * 20, "true"), ("가" * 35, "false"), ("", "false")])
cases("translation_errors", lambda t: F.array_join(rules.translation_errors(F.lit("s1"), F.lit("元の文です"), t, F.lit(2.0)), "|"), [("안녕", ""), ("", "s1: ko_natural is empty"), ("あ가", "s1: ko_natural still contains Japanese kana"), ("A1", "s1: ko_natural contains Latin letters; spell acronyms in Hangul|s1: ko_natural contains raw digits; spell numbers in Korean|s1: ko_natural has no Hangul for Japanese source text"), ("가나다라마바사아자차", "s1: ko_natural exceeds Korean TTS max speech chars 10>7 for 2.000s")])
cases("translation_issues", lambda t: F.array_join(rules.translation_issues(F.lit("媚薬 3"), F.lit(""), F.nullif(t, F.lit("-")), F.lit(True), [("媚薬", ["변비약", "비약"])]), ","), [("-", "missing_translation"), ("", "empty_translation"), ("변비약 3개", "raw_digit,domain_mistranslation"), ("か漢 a", "japanese_kana,untranslated_cjk,latin"), ("좋아요", "")])
cases("back_checks", lambda t: F.concat_ws(":", F.array_join(rules.back_check(t, F.lit("번역 냄새"), ["危", "険"], ["냄새"])["source_hits"], "+"), rules.back_check(t, F.lit("번역 냄새"), ["危", "険"], ["냄새"])["severity"]), [("危険", "危+険:severe"), ("ok", ":warning")])
cases("accepted_translations", lambda t: F.concat_ws(":", *[F.coalesce(x, F.lit("")) for x in (lambda r: (r["status"], r["text"], F.array_join(r["rejected"], "+"), F.array_join(r["warnings"], "+")))(rules.accepted_translation(F.filter(F.split(t, ","), lambda x: x != ""), F.lit("warning"), F.array(F.lit("w")), F.lit("글자 그대로"), F.lit("말"), F.lit(10)))]), [("", "translated:말::w"), ("latin,latin", "needs_manual_review:말:latin:w"), ("natural_repetition_omission", "translated:글자 그대로::w+natural_repetition_omission")])
cases("candidate_scores", lambda t: F.concat_ws(":", *(lambda r: (r["reason"], r["score"].cast("string")))(rules.candidate_score(F.lit("字幕 abcd"), F.lit(2.0), F.lit(0.5), t, F.lit(2.0), F.lit(0.75), t == "leak", ["字幕"]))), [("", "empty_candidate:-100.0"), ("leak", "prompt_or_hallucination_leak:-90.0"), ("x" * 40, "degenerate_repetition:-80.0"), ("字幕", "fallback_still_suspicious:-70.0"), ("abcdefg", "accepted:2.75")])
cases("effect_tags", lambda t: F.array_join(rules.effect_tags(F.split(t, ","), F.array(F.lit("Walkie-Talkie"), F.lit(None))), ","), [("Echo,phone", "telephone,radio,echo"), ("", "radio"), ("robotic, reverb ", "radio,robot,reverb")])
cases("analysis_tokens", lambda t: F.array_join(rules.tokens(F.split(t, ","), F.lit(None).cast("array<string>"), F.array(F.lit(" X y"))), ","), [("A-b,,c", "a_b,c,x_y"), ("", "x_y")])
cases("effect_events", lambda t: F.array_join(F.transform(rules.effect_events(F.from_json(t, f"array<{rules.EVENT}>"), F.lit(5.0)), lambda e: F.concat_ws("/", e["tag"], e["target"], e["start_sec"].cast("string"), e["end_sec"].cast("string"))), ","), [('[{"tag":"Echo","start_sec":-1,"end_sec":9},{"tag":"none"},{"name":"radio","start_sec":3,"end_sec":2,"target":"x"}]', "echo/voice/0.0/5.0,radio/voice/3.0/5.0"), ("[]", "")])
cases("style_responses", lambda t: F.concat_ws("/", *(lambda r: (r["style"], F.array_join(r["tags"], "+"), r["pan"].cast("string"), r["keep"].cast("string"), r["confidence"].cast("string")))(rules.style_response(t))), [('{"spatial_style":"Left Ear","style_tags":["Soft Voice"],"estimated_pan":"-3","keep_original_texture":"no","confidence":"80%"}', "ear_left/soft_voice/-1.0/false/0.8"), ("{}", "center//0.0/true/0.0")])


@query("audio_candidates", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_quantity < 5 THEN 'missing' WHEN l_linenumber = 7 THEN 'read_error:bad' ELSE concat_ws(';', CASE WHEN l_linestatus = 'O' THEN 'format_mismatch' END, CASE WHEN abs(l_quantity - 20) > 1 AND abs(l_quantity - 20) / 20 > 0.5 THEN 'duration_mismatch:' || format('{:.3f}', l_quantity) || 's_vs_20.000s' END, CASE WHEN -l_quantity - 10 <= -55 OR -l_quantity <= -45 THEN 'too_quiet:rms=' || format('{:.1f}', -l_quantity - 10) || 'dbfs,peak=' || format('{:.1f}', -l_quantity) || 'dbfs' END, CASE WHEN l_tax > 0.02 THEN 'clipping:' || format('{:.4f}', l_tax) END) END AS reasons FROM lineitem""")
def audio_candidates(spark, sf):
    q = F.col("l_quantity")
    got = rules.audio_candidate(~((F.col("l_returnflag") == "N") & (q < 5)), F.when(F.col("l_linenumber") == 7, "bad"), F.when(F.col("l_linestatus") == "O", 8000).otherwise(16000), F.lit(1), q, F.lit(20.0), -q - 10, -q, F.col("l_tax"), tolerance=0.5)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(got, ";").alias("reasons"))


@query("voice_candidates", """SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_linenumber = 1 THEN 'manual' END, CASE WHEN l_linestatus = 'O' THEN 'missing_speaker_id' END, CASE WHEN l_linenumber > 1 THEN 'speaker_count_not_one:' || l_linenumber END, CASE WHEN l_returnflag = 'A' THEN 'source_language_mismatch:A' END, CASE WHEN l_discount < 0.05 THEN 'quality_score_below_min:' || format('{:.3f}', l_discount) || '<0.050' END, CASE WHEN l_quantity > 30 THEN 'background_bleed_db_above_max:' || format('{:.3f}', l_quantity) || '>30.000' END) AS reasons FROM (SELECT * REPLACE (CASE l_returnflag WHEN 'A' THEN 'A' ELSE 'N' END AS l_returnflag) FROM lineitem)""")
def voice_candidates(spark, sf):
    n = F.col("l_linenumber")
    got = rules.voice_candidate(F.when(n == 1, F.array(F.lit("manual"))), F.when(F.col("l_linestatus") != "O", "s"), n, F.lit("text"), F.when(F.col("l_returnflag") == "A", "A").otherwise("N"), "N", F.lit("a.wav"), F.col("l_discount"), 0.05, F.col("l_quantity"), 30.0)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(got, ";").alias("reasons"))


@query("clip_gates", """SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_quantity < 10 THEN 'duration_below_min:' || format('{:.3f}', l_quantity) || '<10.000' END, CASE WHEN l_quantity > 40 THEN 'duration_above_max:' || format('{:.3f}', l_quantity) || '>40.000' END, CASE WHEN 13 / l_quantity > 1 THEN 'source_chars_per_sec_above_max:' || format('{:.3f}', 13 / l_quantity) || '>1.000' END) AS reasons FROM lineitem""")
def clip_gates(spark, sf):
    q = F.col("l_quantity")
    got = F.concat(rules.clip_length(q, 10.0, 40.0), rules.speaking_rate(F.lit("thirteen chars"), q, 1.0))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(got, ";").alias("reasons"))


@query("training_policy", """SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_quantity > 12 THEN 'rvc_train_duration_sec_above_max:' || format('{:.3f}', l_quantity) || '>12.000' END, CASE WHEN l_discount * 10 < 0.8 THEN 'rvc_train_quality_score_below_strict_min:' || format('{:.3f}', l_discount * 10) || '<0.800' END, CASE WHEN l_quantity < 18 THEN 'rvc_train_estimated_snr_db_below_min:' || format('{:.3f}', l_quantity) || '<18.000' END, CASE WHEN -l_quantity > -30 THEN 'rvc_train_background_bleed_db_above_max:' || format('{:.3f}', -l_quantity) || '>-30.000' END) AS strict, '' AS balanced FROM lineitem""")
def training_policy(spark, sf):
    q, nothing = F.col("l_quantity"), F.lit(None).cast("double")
    of = lambda preset: F.array_join(rules.training_policy(preset, q, F.col("l_discount") * 10, q, -q, nothing), ";")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", of("strict").alias("strict"), of("balanced").alias("balanced"))


@query("reference_clips", """SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderstatus = 'P' THEN 'asr_quality_gate_tts_blocked' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'asr_quality_gate:reject' END, CASE WHEN o_custkey % 2 = 0 THEN 'voice_training_exclude' END, CASE WHEN o_custkey % 3 = 0 THEN 'voice_training_ineligible' END, CASE WHEN o_custkey % 5 = 0 THEN 'voice_training_unclean' END, CASE WHEN o_custkey % 7 = 0 THEN 'voice_training_effect_tag:echo' END) AS reasons FROM orders""")
def reference_clips(spark, sf):
    k = F.col("o_custkey")
    got = rules.reference_clip(F.col("o_orderstatus") == "P", F.when(F.col("o_orderpriority").startswith("1"), " Reject"), k % 2 == 0, k % 3 != 0, k % 5 != 0, F.when(k % 7 == 0, F.array(F.lit("Echo"), F.lit("clean"))))
    return load(spark, sf, "orders").select("o_orderkey", F.array_join(got, ";").alias("reasons"))


@query("repair_targets", """SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN true WHEN 1 THEN o_orderstatus = 'F' WHEN 2 THEN o_orderstatus = 'F' OR o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 WHEN 3 THEN o_orderkey % 2 = 1 ELSE false END AS target FROM orders""")
def repair_targets(spark, sf):
    k, o = F.col("o_custkey") % 5, F.col("o_orderkey")
    status = F.when(k == 0, "needs_regeneration").when(k == 1, "needs_manual_review").when(k == 2, "failed").when(k == 3, "quarantined").otherwise("ok")
    got = rules.repair_target(status, F.col("o_orderstatus") == "F", o % 2 == 0, o % 3 != 0, F.when(o % 2 == 1, True))
    return load(spark, sf, "orders").select("o_orderkey", got.alias("target"))


cases("pronunciation_checks", lambda t: (lambda r: F.concat_ws(":", r["gate"], F.array_join(r["issues"], "+")))(rules.pronunciation_check(F.get(F.split(t, "/"), 0), F.get(F.split(t, "/"), 1))), [("안녕하세요/안녕하세요!", "pass:"), ("일/예", "pass:"), ("하나둘셋/하나둘셋하나둘셋", "fail:observed_pronunciation_too_long+repetition_overrun"), ("가나다라마바사아자차/가나다라마바사", "warn:low_pronunciation_coverage"), ("가나다라/마바", "fail:pronunciation_coverage_below_threshold"), ("abc/가", "unavailable:empty_expected_text"), ("가/", "fail:empty_transcript"), ("네/네에", "fail:observed_pronunciation_too_long+repetition_overrun+suffix_contamination")])
