"""Words, scores, routes, reasons across tables, and the kernel functions."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timeloom.functions import kernel, numeric, text
from timeloom.functions.time import DAY
from timeloom.operators import intervals, reasons, selection, sequences, words
from timeloom.plans.catalog import query
from timeloom.plans.interval_queries import CHUNKS, HOUR, chunks, days, timed
from timeloom.sources.tables import load

#: Events of a user's day as the timed words of one row; times in hours of the day.
WORDS = f"""{CHUNKS}, w AS (SELECT user_id, r_start // {DAY} AS day, chunk_id, event_type, (r_start % {DAY}) / {HOUR}.0::DOUBLE AS s, (r_start % {DAY}) / {HOUR}.0::DOUBLE + (r_end - r_start) / {HOUR}.0::DOUBLE AS t FROM e)"""


def word_rows(spark, sf):
    c = chunks(spark, sf).withColumn("day", F.floor(F.col("r_start") / DAY))
    start = (F.col("r_start") % DAY) / float(HOUR)
    word = F.struct(start.alias("start"), F.col("chunk_id").alias("id"), (start + (F.col("r_end") - F.col("r_start")) / float(HOUR)).alias("end"), F.col("event_type").alias("text"))
    return c.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(word)).alias("words"))


@query("word_gap_split", f"""WITH {WORDS}, g AS (SELECT *, CASE WHEN s - lag(t) OVER o >= 1 OR lag(t) OVER o IS NULL THEN 1 ELSE 0 END AS open FROM w WINDOW o AS (PARTITION BY user_id, day ORDER BY s, chunk_id)),
p AS (SELECT *, sum(open) OVER (PARTITION BY user_id, day ORDER BY s, chunk_id ROWS UNBOUNDED PRECEDING) - 1 AS part FROM g)
SELECT user_id, day, CAST(part AS INT) AS part, CAST(count(*) AS INT) AS n, string_agg(event_type, ' ' ORDER BY s, chunk_id) AS text FROM p GROUP BY ALL""")
def word_gap_split(spark, sf):
    got = word_rows(spark, sf).select("user_id", "day", F.posexplode(words.split_at_gaps("words", 1.0)).alias("part", "ws"))
    return got.select("user_id", "day", "part", F.size("ws").alias("n"), words.join_text("ws").alias("text"))


@query("word_window_clip", f"""WITH {WORDS}, c AS (SELECT *, (s + t) / 2 BETWEEN 8.0 AND 16.0 AS inside FROM w)
SELECT user_id, day, CAST(count(*) FILTER (inside) AS INT) AS n_kept, round(min(greatest(s, 8.0)) FILTER (inside), 6) AS first, round(max(least(t, 16.0)) FILTER (inside), 6) AS last FROM c GROUP BY ALL""")
def word_window_clip(spark, sf):
    kept = word_rows(spark, sf).withColumn("kept", words.clip("words", F.lit(8.0), F.lit(16.0)))
    e = words.extent("kept")
    return kept.select("user_id", "day", F.size("kept").alias("n_kept"), F.round(e["start"], 6).alias("first"), F.round(e["end"], 6).alias("last"))


@query("tightened_rows", f"""WITH {WORDS}, x AS (SELECT user_id, day, greatest(0.0, min(s) - 0.5) AS s, least(25.0, max(t) + 0.5) AS t FROM w GROUP BY ALL)
SELECT user_id, day, round(CASE WHEN (25.0 - (t - s)) / 25.0 >= 0.2 THEN s ELSE 0.0 END, 6) AS start, round(CASE WHEN (25.0 - (t - s)) / 25.0 >= 0.2 THEN t ELSE 25.0 END, 6) AS "end" FROM x""")
def tightened_rows(spark, sf):
    got = word_rows(spark, sf).select("user_id", "day", words.tighten(F.lit(0.0), F.lit(25.0), "words", 0.5, 0.2).alias("t"))
    return got.select("user_id", "day", F.round("t.start", 6).alias("start"), F.round("t.end", 6).alias("end"))


@query("sibling_level_gate", """SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN max(l_quantity) OVER w - l_quantity > 20 THEN 'quiet_beside_sibling' END, CASE WHEN l_discount > 0.08 THEN 'discount:' || printf('%.3f', l_discount) END) AS reasons FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def sibling_level_gate(spark, sf):
    most = F.max("l_quantity").over(W.partitionBy("l_orderkey"))
    r = reasons.reasons((most - F.col("l_quantity") > 20, "quiet_beside_sibling"), (F.col("l_discount") > 0.08, F.concat(F.lit("discount:"), F.format_string("%.3f", "l_discount"))))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(r, "|").alias("reasons"))


@query("strict_or_relaxed", """WITH n AS (SELECT p_brand, count(*) FILTER (p_size <= 10) AS strict, count(*) FILTER (p_size <= 25) AS relaxed FROM part GROUP BY 1)
SELECT p_partkey, p_brand, CASE WHEN strict >= 25 OR relaxed <= strict THEN 'strict' ELSE 'relaxed' END AS pass FROM part JOIN n USING (p_brand) WHERE p_size <= CASE WHEN strict >= 25 OR relaxed <= strict THEN 10 ELSE 25 END""")
def strict_or_relaxed(spark, sf):
    p = load(spark, sf, "part")
    n = p.groupBy("p_brand").agg(F.count_if(F.col("p_size") <= 10).alias("strict"), F.count_if(F.col("p_size") <= 25).alias("relaxed"))
    chosen = n.select("p_brand", F.when((F.col("strict") >= 25) | (F.col("relaxed") <= F.col("strict")), "strict").otherwise("relaxed").alias("pass"))
    limit = F.when(F.col("pass") == "strict", 10).otherwise(25)
    return p.join(chosen, "p_brand").where(F.col("p_size") <= limit).select("p_partkey", "p_brand", "pass")


@query("preferred_source", """SELECT l_orderkey, coalesce(arg_min(l_linenumber, (l_shipmode, l_linenumber)) FILTER (ok), arg_min(l_linenumber, (l_shipmode, l_linenumber))) AS chosen, count(*) FILTER (ok) = 0 AS last_resort
FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS l_shipmode, l_quantity >= 10 AS ok FROM lineitem) GROUP BY 1""")
def preferred_source(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("rank"), (F.col("l_quantity") >= 10).alias("ok"))
    order = F.struct("rank", "l_linenumber")
    good = F.min(F.when(F.col("ok"), order))
    return rows.groupBy("l_orderkey").agg(F.coalesce(good, F.min(order))["l_linenumber"].alias("chosen"), (F.count_if("ok") == 0).alias("last_resort"))


@query("risk_reasons_by_id_and_overlap", f"""WITH {CHUNKS}, k AS (SELECT user_id, pos, l_start + {6 * HOUR} AS x, l_start + {9 * HOUR} AS y FROM s WHERE pos % 3 = 0),
r AS (SELECT e.chunk_id, 'by_id' AS reason FROM e WHERE chunk_id % 10 = 0 UNION SELECT e.chunk_id, 'overlap' FROM e JOIN k ON e.user_id = k.user_id AND x < r_end AND r_start < y)
SELECT chunk_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY chunk_id""")
def risk_reasons_by_id_and_overlap(spark, sf):
    c = chunks(spark, sf)
    bad = days(c).where("pos % 3 = 0").select("user_id", (F.col("l_start") + 6 * HOUR).alias("l_start"), (F.col("l_start") + 9 * HOUR).alias("l_end"))
    over = intervals.overlap_join(bad, c, ["user_id"], 6 * HOUR).select("chunk_id", F.lit("overlap").alias("reason"))
    both = c.where("chunk_id % 10 = 0").select("chunk_id", F.lit("by_id").alias("reason")).unionByName(over)
    return both.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query("first_match_by_key", "SELECT d.doc_id, min(b.item_id) AS item_id FROM documents d LEFT JOIN benchmark b ON lower(d.text[:2]) = lower(b.text[:2]) GROUP BY 1")
def first_match_by_key(spark, sf):
    key = lambda: F.lower(F.substring("text", 1, 2))
    first = load(spark, sf, "benchmark").groupBy(key().alias("k")).agg(F.min("item_id").alias("item_id"))  # one row a key before the join
    return load(spark, sf, "documents").select("doc_id", key().alias("k")).join(first, "k", "left").select("doc_id", "item_id")


DROP_SQL = text.COMPARE_DROP.replace("'", "''")


@query("first_match_by_text", f"""WITH d AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '{DROP_SQL}', '', 'g')) AS k FROM documents), b AS (SELECT item_id, lower(regexp_replace(coalesce(text, ''), '{DROP_SQL}', '', 'g')) AS k FROM benchmark)
SELECT d.doc_id, min(b.item_id) AS item_id FROM d LEFT JOIN b ON d.k = b.k AND d.k <> '' GROUP BY 1""")
def first_match_by_text(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return selection.first_equal_text(docs, load(spark, sf, "benchmark").select("item_id", "text"), "item_id").select("doc_id", "item_id")


@query("near_duplicate_by_text", f"""WITH r AS (SELECT doc_id, n_chars, first_value(doc_id) OVER w AS rep_id, first_value(n_chars) OVER w AS rep_size FROM documents WINDOW w AS (PARTITION BY sha256(lower(regexp_replace(coalesce(text, ''), '{DROP_SQL}', '', 'g'))) ORDER BY n_chars DESC, doc_id))
SELECT doc_id, rep_id, doc_id <> rep_id AND abs(rep_size - n_chars) <= greatest(2.0, rep_size * 0.03) AS near_duplicate FROM r""")
def near_duplicate_by_text(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "n_chars", F.sha2(text.compare_key(F.col("text")), 256).alias("k"))
    return selection.near_duplicates(rows, "k", "n_chars", "doc_id", 2.0, 0.03).select("doc_id", "rep_id", "near_duplicate")


@query("neighbour_costs", f"""WITH {CHUNKS}, n AS (SELECT *, r_start - lag(r_end) OVER w AS l, lead(r_start) OVER w - r_end AS r FROM e WINDOW w AS (PARTITION BY user_id ORDER BY r_start, chunk_id))
SELECT chunk_id, CASE WHEN l IS NULL AND r IS NULL THEN NULL WHEN r IS NULL OR l <= r + 60000000 THEN 'left' ELSE 'right' END AS side FROM n""")
def neighbour_costs(spark, sf):
    w = W.partitionBy("user_id").orderBy("r_start", "chunk_id")
    left, right = F.col("r_start") - F.lag("r_end").over(w), F.lead("r_start").over(w) - F.col("r_end") + 60_000_000
    costs = F.array_compact(F.array(F.when(left.isNotNull(), F.struct(left.alias("cost"), F.lit("left").alias("side"))), F.when(right.isNotNull(), F.struct(right.alias("cost"), F.lit("right").alias("side")))))
    return chunks(spark, sf).select("chunk_id", F.array_min(costs)["side"].alias("side"))


@query("issue_scores", """WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, 1 - l_discount * 10 AS b, 1 - l_tax * 12 AS c FROM lineitem), m AS (SELECT *, (a + b + c) / 3 AS score, concat_ws(',', CASE WHEN a < 0.2 THEN 'low_a' END, CASE WHEN b < 0.2 THEN 'low_b' END, CASE WHEN c < 0.2 THEN 'low_c' END) AS issues FROM q)
SELECT l_orderkey, l_linenumber, round(score, 6) AS score, issues, CASE WHEN contains(issues, 'low_a') THEN 'reject' WHEN issues <> '' THEN 'review' WHEN score >= 0.6 THEN 'accept' ELSE 'review' END AS recommendation FROM m""")
def issue_scores(spark, sf):
    a, b, c = F.col("l_quantity") / 50, 1 - F.col("l_discount") * 10, 1 - F.col("l_tax") * 12
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((a + b + c) / 3).alias("s"), reasons.reasons((a < 0.2, "low_a"), (b < 0.2, "low_b"), (c < 0.2, "low_c")).alias("i"))
    verdict = F.when(F.array_contains("i", "low_a"), "reject").when(F.size("i") > 0, "review").when(F.col("s") >= 0.6, "accept").otherwise("review")
    return rows.select("l_orderkey", "l_linenumber", F.round("s", 6).alias("score"), F.array_join("i", ",").alias("issues"), verdict.alias("recommendation"))


@query("rule_routes", """SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'F' THEN 'primary' ELSE 'secondary' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'fast' END) AS backends, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_totalprice > 200000 THEN 'size' ELSE 'default' END AS reason FROM orders""")
def rule_routes(spark, sf):
    large, urgent = F.col("o_totalprice") > 200000, F.col("o_orderpriority").startswith("1")
    backends = F.array_compact(F.array(F.when(large, "large"), F.when(F.col("o_orderstatus") == "F", "primary").otherwise("secondary"), F.when(urgent, "fast")))
    return load(spark, sf, "orders").select("o_orderkey", F.array_join(backends, ",").alias("backends"), reasons.first_reason((urgent, "urgent"), (large, "size"), (F.lit(True), "default")).alias("reason"))


@query("epoch_recommendation", """SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS clean, CAST(greatest(10, least(40, ceil(20 * sqrt(3000.0::DOUBLE / sum(p_size))))) AS BIGINT) AS epochs FROM part GROUP BY 1""")
def epoch_recommendation(spark, sf):
    got = load(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_size").alias("clean"))
    return got.withColumn("epochs", numeric.clamp(F.ceil(20 * F.sqrt(3000.0 / F.col("clean"))), 10, 40).cast("long"))


@query("set_difference_gate", """SELECT o_custkey, array_to_string(list_sort(list_filter(list(DISTINCT o_orderstatus), lambda x: x NOT IN ('O', 'P'))), ',') AS other, len(list_filter(list(DISTINCT o_orderstatus), lambda x: x NOT IN ('O', 'P'))) = 0 AS included FROM orders GROUP BY 1""")
def set_difference_gate(spark, sf):
    got = load(spark, sf, "orders").groupBy("o_custkey").agg(F.array_except(F.collect_set("o_orderstatus"), F.array(F.lit("O"), F.lit("P"))).alias("x"))
    return got.select("o_custkey", F.array_join(F.array_sort("x"), ",").alias("other"), (F.size("x") == 0).alias("included"))


@query("timing_bins", """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 15 THEN 2 WHEN l_quantity < 20 THEN 3 WHEN l_quantity < 30 THEN 4 WHEN l_quantity < 40 THEN 5 ELSE 6 END AS INT) AS bin, round(greatest(0.0, least(1.0, 1 - abs(ln(l_quantity / 25) / ln(2)))), 6) AS pacing FROM lineitem""")
def timing_bins(spark, sf):
    q = F.col("l_quantity")
    edges = (5, 10, 15, 20, 30, 40)
    n = sum(((q >= e).cast("int") for e in edges), F.lit(0))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.alias("bin"), F.round(numeric.clamp(1 - F.abs(F.ln(q / 25) / F.ln(F.lit(2.0))), 0.0, 1.0), 6).alias("pacing"))


@query("acceptance_funnel", """SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS accepted, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def acceptance_funnel(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "lang").join(load(spark, sf, "labels"), "doc_id", "left")
    n = lambda c: F.count_if(c)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), n((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accepted"), n(F.col("quality") == 0).alias("poor"), n(F.col("toxic") == 1).alias("toxic"), n(F.col("quality").isNull()).alias("unlabelled"))


@query("repeated_ngram_share", """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
e AS (SELECT doc_id, k, i, CASE k WHEN 2 THEN a2 WHEN 3 THEN a3 WHEN 4 THEN a4 ELSE a5 END AS same FROM (SELECT doc_id, i, ch = lag(ch, 2) OVER w AS a2, ch = lag(ch, 3) OVER w AS a3, ch = lag(ch, 4) OVER w AS a4, ch = lag(ch, 5) OVER w AS a5 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)), (VALUES (2), (3), (4), (5)) AS t(k)),
g AS (SELECT doc_id, k, i - row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS g FROM e WHERE same), r AS (SELECT doc_id, k, count(*) AS run FROM g GROUP BY doc_id, k, g),
b AS (SELECT doc_id, max((run + k) // k * k) AS best FROM r WHERE (run + k) // k >= 8 GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text <> '' THEN coalesce(best, 0) / length(d.text) ELSE 0 END::DOUBLE AS share FROM documents d LEFT JOIN b USING (doc_id)""")
def repeated_ngram_share(spark, sf):
    return load(spark, sf, "documents").select("doc_id", kernel.repeated_ngram_share("text").alias("share"))


@query("lcs_coverage")
def lcs_coverage(spark, sf):
    """Coverage of each turn's words by the next turn's, as a longest common subsequence."""
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = load(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"), F.split(F.coalesce(after, F.lit("")), " ").alias("b"))
    share = kernel.lcs_length("a", "b") / F.size("a")
    return rows.select("conv_id", "turn", share.alias("coverage"), F.when(share >= 0.82, "pass").when(share >= 0.62, "warn").otherwise("fail").alias("verdict"))


@query("absorbed_segments")
def absorbed_segments(spark, sf):
    return sequences.absorb_short(timed(spark, sf).select("user_id", "start", "end"), ["user_id"], 20 * 60_000_000, 6 * HOUR, DAY)


@query("picked_spans", """WITH r AS (SELECT user_id, event_id AS chunk_id, epoch_us(ts) AS start, epoch_us(ts) + 12 * 3600000000 AS "end", (event_id % 17)::DOUBLE AS score FROM events),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, chunk_id) = 1),
b AS (SELECT r.* FROM r JOIN a USING (user_id) WHERE r."end" <= a.start OR r.start >= a."end" QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY r.score DESC, r.chunk_id) = 1),
c AS (SELECT r.* FROM r JOIN a USING (user_id) JOIN b USING (user_id) WHERE (r."end" <= a.start OR r.start >= a."end") AND (r."end" <= b.start OR r.start >= b."end") QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY r.score DESC, r.chunk_id) = 1)
SELECT user_id, chunk_id, start, "end", score FROM a UNION ALL SELECT user_id, chunk_id, start, "end", score FROM b UNION ALL SELECT user_id, chunk_id, start, "end", score FROM c""")
def picked_spans(spark, sf):
    rows = timed(spark, sf).withColumn("end", F.col("start") + 12 * HOUR).withColumn("score", (F.col("chunk_id") % 17).cast("double"))
    return sequences.pick_apart(rows, ["user_id"], "score", "chunk_id", 3)


@query("loose_json_objects", "SELECT event_id, replace(props, ' ', '') AS json FROM events")
def loose_json_objects(spark, sf):
    broken = F.concat(F.lit("answer: ```json\n"), F.regexp_replace("props", "}$", ",}"), F.lit("\n``` done"))
    return load(spark, sf, "events").select("event_id", kernel.loose_json(broken).alias("json"))


@query("best_of_ranked", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def best_of_ranked(spark, sf):
    return selection.top(load(spark, sf, "customer"), ["c_nationkey"], F.desc("c_acctbal"), F.asc("c_custkey"), k=3).select("c_nationkey", "c_custkey")
