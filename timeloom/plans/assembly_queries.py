"""Segments put together, cut and absorbed; speakers routed and merged. Events stand in for chunks, lines of orders for overlaps."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeloom.operators import assembly, speakers
from timeloom.plans.case_queries import cases
from timeloom.plans.catalog import query
from timeloom.sources.tables import load

CHUNK = """c AS (SELECT user_id, event_id, (event_id % 97 - 3)::DOUBLE AS start, (event_id % 97 - 3 + event_id % 41 * 0.9::DOUBLE) AS "end", CASE WHEN event_id % 7 = 0 THEN ' 　' ELSE ' ' || event_type || ' ' END AS text FROM events)"""


def chunk_rows(spark, sf):
    e, i = load(spark, sf, "events"), F.col("event_id")
    return e.select("user_id", "event_id", (i % 97 - 3).cast("double").alias("start"), (i % 97 - 3 + i % 41 * F.lit(0.9)).alias("end"), F.when(i % 7 == 0, " 　").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("text"))


@query("valid_chunks", f"""WITH {CHUNK}, d AS (SELECT user_id, event_id, greatest(0, start) AS s, least(greatest(greatest(0, start), "end"), 80) AS e, trim(text, ' 　') AS t FROM c)
SELECT user_id, event_id, round(s, 6) AS start, round(e, 6) AS "end", t AS text FROM d WHERE t <> '' AND e - s > 0.05 AND NOT (e - s > 30 AND length(t) / (e - s) < 0.2)""")
def valid_chunks(spark, sf):
    got = assembly.valid_chunks(chunk_rows(spark, sf), F.lit(80.0), 30.0, 0.2)
    return got.select("user_id", "event_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")


@query("repair_chunks", f"""WITH {CHUNK} SELECT user_id, event_id, round(greatest(0, start), 6) AS start FROM c WHERE trim(text, ' 　') <> '' AND least(greatest(greatest(0, start), "end"), 80) - greatest(0, start) > 0.05""")
def repair_chunks(spark, sf):
    return assembly.valid_chunks(chunk_rows(spark, sf), F.lit(80.0), None).select("user_id", "event_id", F.round("start", 6).alias("start"))


cases("split_texts", lambda t: F.array_join(assembly.split_text(t, F.lit(2)), "|"), [("hello wide world", "hello|wide world"), ("今日は。また明日", "今日は。|また明日"), ("abcdefgh", "abcd|efgh"), ("x", "x"), ("行きます行きます", "行きます|行きます"), ("よねわよ猫が居るよ", "よねわよ|猫が居るよ")])
cases("boundary_scores", lambda t: assembly.boundary_score(t, F.lit(2)).cast("string"), [("a b", "100"), ("ab。", "95"), ("です猫", "85"), ("あよ猫", "70"), ("あ猫が", "60"), ("abc", "0"), ("ab", "0")])
cases("cut_words", lambda t: assembly.split_inside_word(F.get(F.split(t, "/"), 0), F.get(F.split(t, "/"), 1)).cast("string"), [("食/べる", "true"), ("きっ/と", "true"), ("カ/ー", "true"), ("犬/猫", "false"), ("あ/い", "false")])


@query("merged_countdowns", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
v AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 30 - pos % 9 END AS v FROM r),
o AS (SELECT *, sum(CASE WHEN v = lag(v) OVER w - 1 THEN 0 ELSE 1 END) OVER w AS run FROM v WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
k AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, row_number() OVER (PARTITION BY user_id, run ORDER BY pos) AS i FROM o)
SELECT user_id, event_id, CAST(sum(CASE WHEN n >= 3 AND i > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS BIGINT) AS grp FROM k""".replace("sum(CASE WHEN v = lag(v) OVER w - 1 THEN 0 ELSE 1 END) OVER w AS run FROM v WINDOW w AS (PARTITION BY user_id ORDER BY pos)", "sum(op) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY user_id ORDER BY pos) - 1 THEN 0 ELSE 1 END AS op FROM v)"))
def merged_countdowns(spark, sf):
    r = load(spark, sf, "events").select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("pos"))
    text = F.when(F.col("event_id") % 5 == 0, "words").otherwise((30 - F.col("pos") % 9).cast("string"))
    rows = r.select("user_id", "event_id", "pos", F.col("pos").cast("double").alias("start"), (F.col("pos") + 0.5).alias("end"), text.alias("text"))
    return assembly.merge_countdowns(rows, ["user_id"], ["pos"], 2.5, 60.0).select("user_id", "event_id", "grp")


@query("assembled_segments")
def assembled_segments(spark, sf):
    rows = chunk_rows(spark, sf)
    return assembly.assemble(rows.select("user_id", "start", "end", "text"), ["user_id"], F.lit(100.0), 3.0, 1.0)


@query("repair_groups", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, value < 60 AS bad FROM events),
o AS (SELECT *, CASE WHEN bad AND lag(bad) OVER (PARTITION BY user_id ORDER BY pos) THEN 0 ELSE 1 END AS op FROM r),
g AS (SELECT *, sum(op) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS grp FROM o), c AS (SELECT *, count(*) OVER (PARTITION BY user_id, grp) AS n FROM g)
SELECT user_id, min(pos)::DOUBLE AS start, max(pos) + 0.5::DOUBLE AS "end", CASE WHEN any_value(n) > 1 THEN 'again ' || any_value(grp)::BIGINT ELSE any_value(event_id)::VARCHAR END AS text, any_value(n) > 1 AS repaired FROM c GROUP BY user_id, grp""")
def repair_groups(spark, sf):
    r = load(spark, sf, "events").select("user_id", F.col("event_id").cast("string").alias("text"), (F.col("value") < 60).alias("bad"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("pos"))
    rows = r.select("*", F.col("pos").cast("double").alias("start"), (F.col("pos") + 0.5).alias("end"))
    grouped = assembly.repair_groups(rows, ["user_id"], ["pos"], "bad", 1.0, 1e9)
    found = grouped.groupBy("user_id", "grp").agg(F.count("*").alias("n")).where("n > 1").select("user_id", "grp", F.concat(F.lit("again "), F.col("grp").cast("string")).alias("text"))
    return assembly.apply_repairs(grouped, found, ["user_id"])


@query("activity_pieces", """SELECT o_orderkey, CASE WHEN a >= 1.25 THEN 'texture:0.0-' || (a - 0.25)::DOUBLE || ';' ELSE '' END || 'speech:' || greatest(0, a - 0.25)::DOUBLE || '-' || (a + 1.25)::DOUBLE || ':one;texture:' || (a + 1.25)::DOUBLE || '-' || (a + 9.75)::DOUBLE || ';speech:' || (a + 9.75)::DOUBLE || '-' || (a + 12.25)::DOUBLE || ':two;texture:' || (a + 12.25)::DOUBLE || '-40.0' AS pieces FROM (SELECT o_orderkey, o_orderkey % 10 AS a FROM orders)""")
def activity_pieces(spark, sf):
    a = (F.col("o_orderkey") % 10).cast("double")
    span = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    pieces = assembly.activity_pieces(F.lit(0.0), F.lit(40.0), F.lit("one two"), F.array(span(a, a + 1), span(a + 10, a + 12)))
    told = lambda p: F.concat(p["kind"], F.lit(":"), p["start"].cast("string"), F.lit("-"), p["end"].cast("string"), F.when(p["kind"] == "speech", F.concat(F.lit(":"), p["text"])).otherwise(""))
    return load(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(pieces, told), ";").alias("pieces"))


@query("word_timelines", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN array_to_string(list_transform([k + 2, k + 1, k], lambda v: v || '@' || (k + 2 - v)::DOUBLE), ',') END AS line FROM (SELECT o_orderkey, o_orderkey % 50 AS k FROM orders)""")
def word_timelines(spark, sf):
    k = (F.col("o_orderkey") % 50).cast("int")
    words = F.transform(F.array(k + 2, k + 1, k), lambda v: F.struct((k + 2 - v).cast("double").alias("start"), (k + 2 - v + 0.5).cast("double").alias("end"), F.concat(v.cast("string"), F.lit("、")).alias("text")))
    words = F.when(F.col("o_orderkey") % 3 == 0, F.slice(words, 1, 2)).otherwise(words)
    line = assembly.word_timeline(words, F.array(k + 2, k + 1, k), F.lit(None))
    return load(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(line, lambda x: F.concat(x["value"].cast("string"), F.lit("@"), x["start"].cast("string"))), ",").alias("line"))


@query("forward_spans", """WITH r AS (SELECT user_id, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (event_id % 5 + 1)::DOUBLE AS d FROM events),
c AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY i) AS upto FROM r)
SELECT a.user_id, a.pos, CAST(min(b.i) - any_value(a.i) + 1 AS INT) AS n, min(b.upto) - any_value(a.upto) + any_value(a.d) AS seconds FROM c a JOIN c b ON a.user_id = b.user_id AND b.i BETWEEN a.i AND a.i + 12 AND b.upto - a.upto + a.d >= 10 GROUP BY 1, 2""")
def forward_spans(spark, sf):
    rows = spans_rows(spark, sf)
    return assembly.forward_spans(rows, ["user_id"], ["pos"], 10.0, 1e9, 1e9)


def spans_rows(spark, sf):
    e = load(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("i"))
    return e.select("user_id", "pos", (F.col("i") * 10.0).cast("double").alias("start"), (F.col("i") * 10.0 + F.col("pos") % 5 + 1).cast("double").alias("end"))


@query("grown_spans")
def grown_spans(spark, sf):
    return assembly.grown_spans(spans_rows(spark, sf), ["user_id"], ["pos"], 8.0, 14.0, 9.0)


@query("absorbed_rows", """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
t AS (SELECT *, CASE WHEN pos % 4 = 0 THEN pos - 1 END AS target FROM r), o AS (SELECT *, coalesce(target, pos) AS owner FROM t),
w AS (SELECT user_id, owner, string_agg(event_type, ' ' ORDER BY pos) AS joined, min(pos) AS s, max(pos) AS e FROM o GROUP BY 1, 2)
SELECT user_id, pos::INT AS pos, CASE WHEN target IS NULL THEN joined END AS text, (CASE WHEN target IS NULL THEN s ELSE pos END)::DOUBLE AS start, (CASE WHEN target IS NULL THEN e ELSE pos END + 0.5)::DOUBLE AS "end", CASE WHEN target IS NULL THEN 'kept' ELSE 'absorbed' END AS status FROM o JOIN w USING (user_id, owner)""")
def absorbed_rows(spark, sf):
    r = load(spark, sf, "events").select("user_id", F.col("event_type").alias("text"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("pos"))
    rows = r.select("*", F.col("pos").cast("double").alias("start"), (F.col("pos") + 0.5).alias("end"), F.when(F.col("pos") % 4 == 0, F.col("pos") - 1).alias("target"))
    return assembly.absorb_into(rows, ["user_id"], "pos", "target").select("user_id", "pos", "text", "start", "end", "status")


@query("span_reasons", """SELECT o_orderkey, ([ '', 'sparse_prompt', 'repetitive_prompt', 'source_split_inside_japanese_word:1->2' ])[o_orderkey % 4 + 1] AS reasons FROM orders""")
def span_reasons(spark, sf):
    row = lambda i, t: F.struct(F.lit(i).alias("id"), t.alias("text"))
    pick = lambda *t: F.get(F.array(*map(F.lit, t)), (F.col("o_orderkey") % 4).cast("int"))
    df = load(spark, sf, "orders").withColumn("rows", F.array(row(1, pick("good morning to all", "hm", "pon pon pon ", "明日食")), row(2, pick("and again", ".", "pon pon", "べる物があります"))))
    return df.select("o_orderkey", F.array_join(assembly.span_reasons("rows", F.lit(5.0)), ",").alias("reasons"))


@query("matching_items", """WITH e AS (SELECT user_id, event_id, event_type, event_id % 1000 AS s, event_id % 1000 + event_id % 7 + 1 AS t FROM events),
i AS (SELECT user_id, event_id AS item, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS item_row, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS item_text, event_id % 1000 + 0.5 AS s, event_id % 1000 + 3 AS t FROM events)
SELECT e.event_id, i.item, round((least(e.t, i.t) - greatest(e.s, i.s)) / least(e.t - e.s, i.t - i.s), 6)::DOUBLE AS ratio FROM e JOIN i ON e.user_id = i.user_id AND e.s < i.t AND i.s < e.t
WHERE (least(e.t, i.t) - greatest(e.s, i.s)) / least(e.t - e.s, i.t - i.s) >= 0.3 AND (item_row IS NULL OR item_row = e.event_id) AND (item_text = '' OR contains(event_type, item_text) OR contains(item_text, event_type))""")
def matching_items(spark, sf):
    e, i = load(spark, sf, "events"), F.col("event_id")
    s = (i % 1000).cast("double")
    rows = e.select("user_id", "event_id", i.alias("row_id"), F.col("event_type").alias("text"), s.alias("l_start"), (s + i % 7 + 1).alias("l_end"))
    items = e.select("user_id", i.alias("item"), F.when(i % 3 == 0, i - 1).alias("item_row"), F.when(i % 2 == 0, F.col("event_type")).otherwise("").alias("item_text"), (s + 0.5).alias("r_start"), (s + 3).alias("r_end"))
    return speakers.matching_items(rows, items, ["user_id"], 8.0).select("event_id", "item", F.round("ratio", 6).alias("ratio"))


@query("merged_overlaps", """WITH s AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'A' ELSE l_returnflag END AS k, sum(l_quantity) AS o, sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey) AS d FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM s)
SELECT l_orderkey, n, k AS speaker, round(o / d, 6) AS ratio, n = 1 OR o / d >= 0.6 AS accepted FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY o DESC, k DESC) = 1""")
def merged_overlaps(spark, sf):
    line = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("speaker"), F.col("l_quantity").alias("overlap"), F.sum("l_quantity").over(W.partitionBy("l_orderkey")).alias("seconds"))
    merges = spark.createDataFrame([("R", "A")], "speaker string, target string")
    return speakers.merged_overlaps(line, ["l_orderkey"], "speaker", "overlap", merges, "seconds").select("l_orderkey", "n", "speaker", F.round("ratio", 6).alias("ratio"), "accepted")


@query("routed_rows")
def routed_rows(spark, sf):
    e, i = load(spark, sf, "events"), F.col("event_id")
    rows = e.select("user_id", i.alias("pos"), (i * 2.0).cast("double").alias("start"), (i * 2.0 + 1).cast("double").alias("end"), F.when(i % 3 == 0, F.col("event_type")).alias("speaker"), (i % 11 == 0).alias("skip"), (i % 3).cast("double").alias("n"), F.col("event_type").alias("candidate"), (F.col("value") / 200).alias("ratio"), (i % 13 == 0).alias("texture"), F.lit(True).alias("has_text"))
    return speakers.route_rows(rows, ["user_id"]).select("user_id", "pos", "speaker", "skip", "reason")


@query("merged_speakers", """WITH st AS (SELECT label, count(*) AS n, sum(vec_id % 10)::DOUBLE AS seconds FROM embeddings GROUP BY 1), v AS (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS e FROM embeddings GROUP BY 1),
lim AS (SELECT median(seconds) AS m FROM st), p AS (SELECT s.label AS a, l.label AS b, list_cosine_similarity(x.e, y.e) AS c, s.n FROM st s, st l, v x, v y, lim WHERE s.seconds < m AND l.seconds >= m AND x.label = s.label AND y.label = l.label),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) = 1)
SELECT a AS speaker, b AS target, round(c, 4)::DOUBLE AS cosine, CASE WHEN c >= 0.1 THEN 'clean_centroid' WHEN n >= 45 THEN 'distinct_low_similarity' ELSE 'major_bucket_fallback' END AS basis FROM t""")
def merged_speakers(spark, sf):
    e = load(spark, sf, "embeddings")
    stats = e.groupBy(F.col("label").alias("speaker")).agg(F.count("*").alias("n"), F.sum(F.col("vec_id") % 10).cast("double").alias("seconds"))
    vectors = e.groupBy(F.col("label").alias("speaker")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    limit = stats.agg(F.percentile("seconds", F.lit(0.5))).first()[0]
    return speakers.merge_small(stats, vectors, limit, 0.1, 45).select("speaker", "target", F.round("cosine", 4).alias("cosine"), "basis")


@query("source_clusters")
def source_clusters(spark, sf):
    e = load(spark, sf, "embeddings").select((F.col("vec_id") % 3).alias("project"), (F.col("vec_id") % 5).alias("source"), "label", F.col("vec_id").alias("start"), F.col("embedding").alias("vector"))
    return speakers.source_clusters(e, "project", ["source", "label"], "start", "vector", 0.75)


@query("attempts_summary", """SELECT l_suppkey, CAST(max(l_linenumber) AS INT) AS rounds, count(*) FILTER (l_returnflag = 'R') AS manual_review, count(*) FILTER (l_returnflag = 'A') AS quarantined, count(*) FILTER (l_linestatus <> 'F') AS verification_failed, CAST(sum(l_quantity::BIGINT % 3) AS BIGINT) AS stale_filtered FROM lineitem GROUP BY 1""")
def attempts_summary(spark, sf):
    status = F.when(F.col("l_returnflag") == "R", "needs_manual_review").when(F.col("l_returnflag") == "A", "quarantined")
    rows = load(spark, sf, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("round"), status.alias("status"), (F.col("l_linestatus") == "F").alias("verified"), (F.col("l_quantity").cast("long") % 3).alias("stale"))
    return speakers.attempts_summary(rows, ["l_suppkey"])


@query("merged_summaries", """SELECT o_custkey, CAST(sum(o_orderkey % 4) AS BIGINT) AS changed, array_to_string(list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderkey % 2 = 0), ',') AS items, coalesce(max(o_totalprice) FILTER (o_orderstatus = 'F'), max(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS seconds FROM orders GROUP BY 1""")
def merged_summaries(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_orderkey") % 4).alias("changed"), F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("items"))
    made = speakers.merged_summaries(o, ["o_custkey"], ["changed"], "items", "o_orderkey")
    best = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    seconds = o.groupBy("o_custkey").agg(speakers.clean_seconds(best("F"), best("O")).alias("seconds"))
    return made.join(seconds, "o_custkey").select("o_custkey", "changed", F.when(F.size("items") > 0, F.array_join("items", ",")).alias("items"), "seconds")
