"""Gates, statistics, grades, selection, de-duplication and lineage."""

from pyspark.sql import functions as F

from timeloom.functions import numeric, text
from timeloom.operators import containment, aggregates, intervals, lineage, reasons, selection, vectors
from timeloom.plans.catalog import query
from timeloom.sources.tables import load


@query("weighted_confidence", "SELECT lang, round(sum(quality * n_chars) / sum(n_chars), 6) AS confidence, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def weighted_confidence(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(load(spark, sf, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.round(intervals.weighted_mean(F.col("quality"), F.col("n_chars")), 6).alias("confidence"), F.count("*").alias("n"))


@query("linear_percentile_stats", """SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 6) AS least, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(median(l_extendedprice), 6) AS median,
round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(avg(l_extendedprice), 4) AS mean, round(max(l_extendedprice), 6) AS greatest FROM lineitem GROUP BY 1""")
def linear_percentile_stats(spark, sf):
    return aggregates.numeric_stats(load(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("dominant_key_share", """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS rows, arg_min(event_type, (-n, event_type)) AS top_key, round(max(n) / sum(n), 6) AS top_share, count(event_type) AS n_keys, 0.0::DOUBLE AS missing_share FROM n GROUP BY user_id""")
def dominant_key_share(spark, sf):
    return aggregates.dominant_share(load(spark, sf, "events"), ["user_id"], "event_type").withColumn("top_share", F.round("top_share", 6))


LENGTH_REASONS = """CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long:' || n_chars END, CASE WHEN text LIKE '%|%' THEN 'table' END, CASE WHEN text LIKE '%!!%' THEN 'shouting' END, CASE WHEN lang <> 'en' THEN 'lang:' || lang END"""


def judged_documents(spark, sf):
    d = load(spark, sf, "documents")
    c = F.col
    return reasons.gate(d, (c("n_chars") < 200, "short"), (c("n_chars") > 5000, F.concat(F.lit("long:"), c("n_chars").cast("string"))), (c("text").contains("|"), "table"), (c("text").contains("!!"), "shouting"), (c("lang") != "en", F.concat(F.lit("lang:"), c("lang"))))


@query("reject_reason_lists", f"SELECT doc_id, concat_ws('|', {LENGTH_REASONS}) AS reasons, concat_ws('|', {LENGTH_REASONS}) = '' AS accepted FROM documents")
def reject_reason_lists(spark, sf):
    return judged_documents(spark, sf).select("doc_id", F.array_join("reasons", "|").alias("reasons"), "accepted")


@query("reject_reason_counts", f"SELECT split_part(r, ':', 1) AS reason, count(*) AS n FROM (SELECT unnest([{LENGTH_REASONS}]) AS r FROM documents) WHERE r IS NOT NULL GROUP BY 1")
def reject_reason_counts(spark, sf):
    return reasons.reason_counts(judged_documents(spark, sf))


@query("dataset_grade", """SELECT source, count(*) AS n, CAST(sum(CASE WHEN quality = 1 THEN n_chars ELSE 0 END) AS BIGINT) AS clean_chars, round(avg(quality), 6) AS mean_quality, CASE
  WHEN sum(CASE WHEN quality = 1 THEN n_chars ELSE 0 END) / 100 < 30 OR avg(quality) < 0.5 THEN 'poor'
  WHEN sum(CASE WHEN quality = 1 THEN n_chars ELSE 0 END) / 100 >= 600 AND avg(quality) >= 0.85 AND avg(toxic) <= 0.1 AND avg(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) >= 0.9 THEN 'excellent'
  WHEN sum(CASE WHEN quality = 1 THEN n_chars ELSE 0 END) / 100 >= 120 AND avg(quality) >= 0.7 AND avg(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) >= 0.3 THEN 'good' ELSE 'mixed' END AS grade
FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def dataset_grade(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(load(spark, sf, "labels"), "doc_id")
    clean = F.sum(F.when(F.col("quality") == 1, F.col("n_chars")).otherwise(0))
    got = rows.groupBy("source").agg(F.count("*").alias("n"), clean.alias("clean_chars"), F.avg("quality").alias("q"), F.avg("toxic").alias("t"), F.avg((F.col("lang") == "en").cast("int")).alias("share"))
    return got.select("source", "n", "clean_chars", F.round("q", 6).alias("mean_quality"), aggregates.grade(F.col("clean_chars") / 100, F.col("q"), F.col("t"), F.col("share"), F.lit(0.0)).alias("grade"))


@query("majority_vote_text", """WITH v AS (SELECT source, md5(text) AS k, count(*) AS votes, max(n_chars) AS best_score, arg_max(doc_id, (n_chars, -doc_id)) AS winner FROM documents GROUP BY ALL)
SELECT * FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY votes DESC, best_score DESC, k) = 1) WHERE votes >= 2""")
def majority_vote_text(spark, sf):
    return selection.vote(load(spark, sf, "documents").withColumn("k", F.md5("text")), ["source"], "k", "n_chars", "doc_id")


@query("status_histogram", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def status_histogram(spark, sf):
    return aggregates.histogram(load(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("decision_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY ALL")
def decision_counts(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("rate_recommendation", "SELECT count(*) AS n, count(*) FILTER (quality = 0) AS n_bad, CASE WHEN count(*) FILTER (quality = 0) >= greatest(3, ceil(0.02 * count(*))) THEN 'fallback' ELSE 'keep' END AS recommendation FROM labels")
def rate_recommendation(spark, sf):
    got = load(spark, sf, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("n_bad"))
    return got.withColumn("recommendation", F.when(F.col("n_bad") >= F.greatest(F.lit(3), F.ceil(0.02 * F.col("n"))), "fallback").otherwise("keep"))


@query("bucket_stats", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, count(*) FILTER (quality = 1) AS n_clean, CAST(coalesce(sum(n_chars) FILTER (quality = 1), 0) AS BIGINT) AS clean, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (quality = 1), '') AS clean_ids FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def bucket_stats(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "source", "n_chars").join(load(spark, sf, "labels"), "doc_id", "left")
    ok = F.col("quality") == 1
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(ok, F.col("doc_id")))), lambda x: x.cast("string")), ",")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.count_if(ok).alias("n_clean"), F.coalesce(F.sum(F.when(ok, F.col("n_chars"))), F.lit(0)).alias("clean"), ids.alias("clean_ids"))


@query("exact_medians", "SELECT lang, median(n_chars)::DOUBLE AS median_chars FROM documents GROUP BY lang")
def exact_medians(spark, sf):
    return load(spark, sf, "documents").groupBy("lang").agg(F.percentile("n_chars", F.lit(0.5)).alias("median_chars"))


@query("text_density_gate", """WITH d AS (SELECT doc_id, length(regexp_replace(regexp_replace(text, '^[\\s　]+', ''), '[\\s　]+$', '')) / greatest(0.001, n_chars / 15.0::DOUBLE + doc_id % 7 * 30) AS density, n_chars / 15.0::DOUBLE + doc_id % 7 * 30 AS seconds FROM documents)
SELECT doc_id, round(density, 6) AS density, seconds >= 20 AND density < 5 AS sparse FROM d""")
def text_density_gate(spark, sf):
    seconds = F.col("n_chars") / 15.0 + F.col("doc_id") % 7 * 30
    d = load(spark, sf, "documents").select("doc_id", seconds.alias("seconds"), text.density(F.col("text"), seconds).alias("density"))
    return d.select("doc_id", F.round("density", 6).alias("density"), ((F.col("seconds") >= 20) & (F.col("density") < 5)).alias("sparse"))


ACCENTS = "àâçéèêëîïôûùñäößáíóúü"


@query("script_ratio_gate", f"WITH d AS (SELECT doc_id, regexp_replace(text, '[\\s0-9]', '', 'g') AS t FROM documents) SELECT doc_id, round(coalesce(length(regexp_replace(t, '[^{ACCENTS}]', '', 'g')) / nullif(length(t), 0), 0), 6) AS ratio, coalesce(length(regexp_replace(t, '[^{ACCENTS}]', '', 'g')) / nullif(length(t), 0), 0) >= 0.02 AS accented FROM d")
def script_ratio_gate(spark, sf):
    ratio = text.share(F.col("text"), ACCENTS, "\\s0-9")
    return load(spark, sf, "documents").select("doc_id", F.round(ratio, 6).alias("ratio"), (ratio >= 0.02).alias("accented"))


@query("char_run_filter", """WITH c AS (SELECT doc_id, i, text[i] AS c, text FROM (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS i FROM documents)),
g AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM c), r AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, c, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, coalesce(longest, 0) AS longest, coalesce(longest, 0) >= 3 AND (coalesce(longest, 0) >= 0.55 * length(text) OR length(text) - coalesce(longest, 0) <= 16) AS dominant FROM documents d LEFT JOIN r USING (doc_id)""")
def char_run_filter(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", text.longest_run(F.col("text")).alias("longest"), text.dominant_run(F.col("text"), 3).alias("dominant"))
    return d.select("doc_id", F.col("longest").cast("long").alias("longest"), "dominant")


@query("runaway_numeric_filter", """WITH n AS (SELECT page_id, list_transform(regexp_extract_all(url || ' ' || html, '[0-9]+'), lambda x: x::HUGEINT) AS v FROM pages)
SELECT page_id, len(v) AS n_values, coalesce(list_max(list_transform(list_distinct(v), lambda x: len(list_filter(v, lambda y: y = x)))), 0) AS most_repeated,
len(v) >= 6 AND coalesce(list_max(list_transform(list_distinct(v), lambda x: len(list_filter(v, lambda y: y = x)))), 0) >= 4 AS runaway FROM n""")
def runaway_numeric_filter(spark, sf):
    v = load(spark, sf, "pages").select("page_id", text.numbers(F.concat_ws(" ", "url", "html")).alias("v"))
    each = v.select("page_id", F.explode("v").alias("x")).groupBy("page_id", "x").agg(F.count("*").alias("c")).groupBy("page_id").agg(F.sum("c").alias("n_values"), F.max("c").alias("most_repeated"))
    got = v.select("page_id").join(each, "page_id", "left").na.fill(0)
    return got.select("page_id", "n_values", "most_repeated", ((F.col("n_values") >= 6) & (F.col("most_repeated") >= 4)).alias("runaway"))


@query("ordered_replacements", """WITH r AS (SELECT doc_id, text, replace(replace(replace(text, 'tion', 'shun'), 'the ', 'teh '), 'shun.', 'tion.') AS a FROM documents), s AS (SELECT *, replace(replace(replace(a, 'tion', 'shun'), 'the ', 'teh '), 'shun.', 'tion.') AS b FROM r)
SELECT doc_id, md5(replace(replace(replace(b, 'tion', 'shun'), 'the ', 'teh '), 'shun.', 'tion.')) AS text_md5, CAST((length(text) - length(replace(text, 'tion', ''))) // 4 AS BIGINT) AS hits FROM s""")
def ordered_replacements(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select("doc_id", F.md5(text.replace_all(t, [("tion", "shun"), ("the ", "teh "), ("shun.", "tion.")])).alias("text_md5"), text.count_of(t, "tion").alias("hits"))


@query("guarded_rule_replace", """SELECT doc_id, CASE WHEN contains(text, 'the') AND contains(text, 'and') AND NOT contains(text, '|') THEN 1 WHEN contains(text, 'la') AND NOT contains(text, '!!') THEN 2 END AS rule,
md5(CASE WHEN contains(text, 'the') AND contains(text, 'and') AND NOT contains(text, '|') THEN replace(text, 'the', 'THE') WHEN contains(text, 'la') AND NOT contains(text, '!!') THEN replace(text, 'la', 'LA') ELSE text END) AS text_md5 FROM documents""")
def guarded_rule_replace(spark, sf):
    t = F.col("text")
    rules = [(1, "the", "THE", ("and",), ("|",)), (2, "la", "LA", (), ("!!",))]  # number, source, target, needed cues, barring cues
    rule, out = F.lit(None).cast("int"), t
    for n, source, target, needed, barred in reversed(rules):
        ok = t.contains(source)
        for cue in needed:
            ok = ok & t.contains(cue)
        for cue in barred:
            ok = ok & ~t.contains(cue)
        rule, out = F.when(ok, F.lit(n)).otherwise(rule), F.when(ok, F.replace(t, F.lit(source), F.lit(target))).otherwise(out)
    return load(spark, sf, "documents").select("doc_id", rule.alias("rule"), F.md5(out).alias("text_md5"))


@query("contamination_check", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_check(spark, sf):
    return containment.contained(load(spark, sf, "documents"), "doc_id", load(spark, sf, "benchmark"), "item_id")


@query("text_measures", """SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS speech_chars, length(regexp_replace(text, '[\\s　、。,.，．!！?？]', '', 'g')) AS compact_chars, coalesce(list_max(list_transform(regexp_split_to_array(text, '[,.;]'), lambda x: length(x))), 0) > 200 AS long_clause FROM documents""")
def text_measures(spark, sf):
    t = F.col("text")
    clause = F.exists(F.split(t, "[,.;]"), lambda x: F.length(x) > 200)
    return load(spark, sf, "documents").select("doc_id", text.speech_chars(t).cast("long").alias("speech_chars"), F.length(text.compact(t)).cast("long").alias("compact_chars"), clause.alias("long_clause"))


@query("candidate_argmax_tiebreak", """SELECT l_orderkey, l_linenumber, round(0.6 * l_quantity / 50 + 0.4 * (1 - l_discount), 6) AS score FROM lineitem WHERE l_returnflag <> 'R'
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY round(0.6 * l_quantity / 50 + 0.4 * (1 - l_discount), 6) DESC, l_linenumber DESC, l_partkey DESC) = 1""")
def candidate_argmax_tiebreak(spark, sf):
    score = F.round(0.6 * F.col("l_quantity") / 50 + 0.4 * (1 - F.col("l_discount")), 6)
    rows = load(spark, sf, "lineitem").where("l_returnflag <> 'R'").withColumn("score", score)
    return selection.top(rows, ["l_orderkey"], F.desc("score"), F.desc("l_linenumber"), F.desc("l_partkey")).select("l_orderkey", "l_linenumber", "score")


@query("budget_prefix", """SELECT p_brand, p_partkey, CAST(run AS BIGINT) AS running FROM (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS run FROM part) WHERE run - p_size < 200""")
def budget_prefix(spark, sf):
    return selection.budget_prefix(load(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], "p_size", 200).select("p_brand", "p_partkey", "running")


@query("budget_greedy_skip", """WITH RECURSIVE o AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part),
f AS (SELECT p_brand, p_partkey, k, true AS kept, p_size::DOUBLE AS total FROM o WHERE k = 1 UNION ALL
SELECT o.p_brand, o.p_partkey, o.k, NOT (total >= 100 AND total + p_size > 200), CASE WHEN total >= 100 AND total + p_size > 200 THEN total ELSE total + p_size END FROM f JOIN o ON o.p_brand = f.p_brand AND o.k = f.k + 1)
SELECT p_brand, p_partkey, kept FROM f""")
def budget_greedy_skip(spark, sf):
    rows = load(spark, sf, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return selection.budget_skip(rows, ["p_brand"], ["p_retailprice", "p_partkey"], "p_size", 200, 100).select("p_brand", "p_partkey", "kept")


@query("best_per_key_dedupe", """SELECT doc_id, first_value(doc_id) OVER w AS kept_id, CASE WHEN doc_id <> first_value(doc_id) OVER w THEN 'duplicate_of:' || first_value(doc_id) OVER w END AS reason FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id)""")
def best_per_key_dedupe(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "n_chars", F.md5("text").alias("k"))
    return selection.keep_best(rows, ["k"], F.desc("n_chars"), F.asc("doc_id"), ident="doc_id").select("doc_id", "kept_id", "reason")


@query("near_duplicate_by_key", """WITH r AS (SELECT doc_id, n_chars, first_value(doc_id) OVER w AS rep_id, first_value(n_chars) OVER w AS rep_size FROM documents WINDOW w AS (PARTITION BY md5(text[:40]) ORDER BY n_chars DESC, doc_id))
SELECT doc_id, rep_id, doc_id <> rep_id AND abs(rep_size - n_chars) <= greatest(2.0, rep_size * 0.03) AS near_duplicate FROM r""")
def near_duplicate_by_key(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "n_chars", F.md5(F.substring("text", 1, 40)).alias("k"))
    return selection.near_duplicates(rows, "k", "n_chars", "doc_id", 2.0, 0.03).select("doc_id", "rep_id", "near_duplicate")


@query("completeness_gaps", """WITH g AS (SELECT o_custkey AS k, min(o_orderkey % 40) AS lo, max(o_orderkey % 40) AS hi, list(DISTINCT o_orderkey % 40) AS present FROM orders GROUP BY 1)
SELECT k, lo, hi, array_to_string(list_filter(generate_series(lo, hi), lambda i: NOT list_contains(present, i)), ',') AS missing FROM g""")
def completeness_gaps(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 40).alias("n"))
    got = selection.missing_numbers(rows, ["k"], "n")
    return got.select("k", "lo", "hi", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query("order_preserving_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def order_preserving_distinct(spark, sf):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(turns), ",").alias("roles"))


CENTERS = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM u),
m AS (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(generate_series(1, len(v))) AS i FROM n) GROUP BY ALL), c0 AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label),
c AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM c0)"""


@query("centroid_mean", f"WITH {CENTERS} SELECT label, i AS dim, round(v[i], 5) AS x FROM (SELECT label, v, CAST(unnest(generate_series(1, len(v))) AS INT) AS i FROM c)")
def centroid_mean(spark, sf):
    got = vectors.centroids(load(spark, sf, "embeddings"), "label", "embedding")
    return got.select("label", F.posexplode("embedding").alias("dim", "x")).select("label", (F.col("dim") + 1).alias("dim"), F.round("x", 5).alias("x"))


@query("cosine_nearest", f"""WITH {CENTERS}, s AS (SELECT n.vec_id, c.label, list_dot_product(n.v, c.v) AS cosine FROM n, c)
SELECT vec_id, round(cosine, 5) AS cosine, CASE WHEN cosine >= 0.3 THEN label END AS label FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) = 1""")
def cosine_nearest(spark, sf):
    e = load(spark, sf, "embeddings")
    got = vectors.nearest(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding"), "label", 0.3)
    return got.withColumn("cosine", F.round("cosine", 5))


@query("leader_clusters")
def leader_clusters(spark, sf):
    return vectors.leader_clusters(load(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.75)


@query("duration_policy_gate", """WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity / 12 AS s, l_quantity / 12 * (0.5 + 10 * l_discount) AS o FROM lineitem)
SELECT l_orderkey, l_linenumber, round(o / s, 6) AS ratio, CASE WHEN s < 2.0 THEN CASE WHEN o - s > t THEN 'too_long' WHEN o - s < -t THEN 'too_short' ELSE 'pass' END WHEN o / s > 1.35 THEN 'too_long' WHEN o / s < 0.75 THEN 'too_short' ELSE 'pass' END AS verdict
FROM (SELECT *, CASE WHEN s < 0.7 THEN 0.22 WHEN s < 1.2 THEN 0.30 WHEN s < 2.0 THEN 0.40 END::DOUBLE AS t FROM d)""")
def duration_policy_gate(spark, sf):
    s = F.col("l_quantity") / 12
    p = numeric.duration_policy(s, s * (0.5 + 10 * F.col("l_discount")))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", F.round("p.ratio", 6).alias("ratio"), "p.verdict")


@query("rank_score_tiers", """WITH s AS (SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, l_quantity / 50)) - greatest(0.0, least(1.0, (l_tax - 0.02) / 0.06)) * 0.3 AS score FROM lineitem)
SELECT l_orderkey, l_linenumber, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS tier FROM s""")
def rank_score_tiers(spark, sf):
    score = numeric.clamp(F.col("l_quantity") / 50, 0.0, 1.0) - numeric.soft_upper_penalty(F.col("l_tax"), 0.02, 0.08, 0.3)
    got = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))
    return got.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.4, "medium").otherwise("low").alias("tier"))


@query("countdown_sequences", """WITH v AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber DESC) AS v FROM lineitem GROUP BY 1), d AS (SELECT l_orderkey, v, list_transform(generate_series(2, len(v)), lambda i: v[i] - v[i - 1]) AS d FROM v)
SELECT l_orderkey, len(v) >= 3 AND len(list_filter(d, lambda x: x <> -1)) = 0 AS countdown, len(d) > 0 AND (len(list_filter(d, lambda x: x <> 1)) = 0 OR len(list_filter(d, lambda x: x <> -1)) = 0) AS monotonic,
len(v) >= 2 AND list_contains(list_transform(generate_series(1, len(v) - 1), lambda i: v[i] = 3 AND v[i + 1] = 2), true) AS has_3_2 FROM d""")
def countdown_sequences(spark, sf):
    v = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("long")), asc=False).alias("v")).withColumn("part", F.array(F.lit(3), F.lit(2)).cast("array<bigint>"))
    return v.select("l_orderkey", numeric.is_countdown("v").alias("countdown"), numeric.is_monotonic("v").alias("monotonic"), numeric.contains_run("v", "part").alias("has_3_2"))


@query("stale_lineage_filter", """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 3 END AS f1, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 3 END AS e1, l_partkey % 2 AS f2, o_orderkey % 2 AS e2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN e1 IS NOT NULL AND f1 IS NULL THEN 'missing_script' END, CASE WHEN e1 IS NOT NULL AND f1 <> e1 THEN 'stale_script' END, CASE WHEN f2 <> e2 THEN 'stale_route' END) AS reasons FROM p""")
def stale_lineage_filter(spark, sf):
    rows = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    f1 = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 3)
    e1 = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 3)
    r = lineage.stale_reasons([("script", f1, e1), ("route", F.col("l_partkey") % 2, F.col("o_orderkey") % 2)])
    return rows.select("l_orderkey", "l_linenumber", F.array_join(r, "|").alias("reasons"))


@query("downstream_invalidation", """WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS place, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS script, o_custkey + 1 AS tts, CASE WHEN o_custkey % 2 > 0 THEN o_custkey + 2 END AS rvc, o_custkey + 3 AS qc FROM orders)
SELECT o_orderkey, CASE WHEN place > 0 THEN script END AS script, CASE WHEN place > 1 THEN tts END AS tts, CASE WHEN place > 2 THEN rvc END AS rvc, CASE WHEN place > 3 THEN qc END AS qc,
concat_ws(',', CASE WHEN place <= 0 AND script IS NOT NULL THEN 'script' END, CASE WHEN place <= 1 THEN 'tts' END, CASE WHEN place <= 2 AND rvc IS NOT NULL THEN 'rvc' END, CASE WHEN place <= 3 THEN 'qc' END) AS invalidated FROM o""")
def downstream_invalidation(spark, sf):
    nodes, c = ["script", "tts", "rvc", "qc"], F.col("o_custkey")
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("k"), F.when(c % 3 > 0, c).alias("script"), (c + 1).alias("tts"), F.when(c % 2 > 0, c + 2).alias("rvc"), (c + 3).alias("qc"))
    node = F.get(F.array(*map(F.lit, nodes)), F.col("k").cast("int"))
    return lineage.invalidate(o, nodes, node).select("o_orderkey", *nodes, F.array_join("invalidated", ",").alias("invalidated"))


@query("failure_signature", "SELECT user_id, string_agg(event_type, '|' ORDER BY event_type) AS signature FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50) GROUP BY user_id")
def failure_signature(spark, sf):
    return load(spark, sf, "events").where("value > 50").groupBy("user_id").agg(lineage.signature(F.collect_set("event_type")).alias("signature"))


@query("transitive_merge_map", """WITH RECURSIVE e AS (SELECT n_nationkey AS s, CASE WHEN n_nationkey % 6 = 0 THEN n_nationkey ELSE n_nationkey - 1 END AS t FROM nation), w AS (SELECT s, t FROM e UNION SELECT w.s, e.t FROM w JOIN e ON e.s = w.t)
SELECT s, min(t) AS t FROM w GROUP BY s""")
def transitive_merge_map(spark, sf):
    k = F.col("n_nationkey")
    return lineage.follow(load(spark, sf, "nation").select(k.alias("s"), F.when(k % 6 == 0, k).otherwise(k - 1).alias("t")), "s", "t")


@query("latest_status", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def latest_status(spark, sf):
    return lineage.latest(load(spark, sf, "orders"), ["o_custkey"], F.col("o_orderkey"), "o_orderstatus")


@query("group_fingerprint", "SELECT user_id, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS fingerprint FROM events GROUP BY user_id")
def group_fingerprint(spark, sf):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return load(spark, sf, "events").groupBy("user_id").agg(F.sha2(ids, 256).alias("fingerprint"))


@query("loose_json_fields", """SELECT event_id, k, CASE WHEN k > 1 THEN least(1.0, k / 100) ELSE greatest(0.0, k) END AS confidence FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def loose_json_fields(spark, sf):
    raw = F.get_json_object("props", "$.k")
    return load(spark, sf, "events").select("event_id", raw.cast("double").alias("k"), text.confidence(raw).alias("confidence"))


@query("unlabelled_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf):
    return load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("mapped_keys", "SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def mapped_keys(spark, sf):
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return load(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")


@query("natural_order", """WITH u AS (SELECT page_id, url, regexp_extract_all(url, '[0-9]+|[^0-9]+') AS p FROM pages WHERE url IS NOT NULL), k AS (SELECT page_id, array_to_string(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(length(regexp_replace(x, '^0+([0-9])', '\\1'))::VARCHAR, 8, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE lower(x) END), '') AS k FROM u)
SELECT page_id, md5(k) AS key_md5 FROM k""")
def natural_order(spark, sf):
    return load(spark, sf, "pages").where("url is not null").select("page_id", F.md5(text.natural_key(F.col("url"))).alias("key_md5"))
