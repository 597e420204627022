"""Interval joins, islands, batches, neighbours and folds."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timeloom.functions.time import DAY, micros
from timeloom.operators import intervals, sequences
from timeloom.plans.catalog import query
from timeloom.sources.tables import load

HOUR = 3_600_000_000
#: Events as chunks: a time, an end some minutes later, a confidence; days of a user as segments.
CHUNKS = f"""e AS (SELECT user_id, event_id AS chunk_id, event_type, epoch_us(ts) AS r_start, epoch_us(ts) + (event_id % 50 + 1) * 60000000 AS r_end, (event_id % 101) / 100.0::DOUBLE AS conf FROM events),
s AS (SELECT DISTINCT user_id, r_start // {DAY} AS pos, r_start // {DAY} * {DAY} AS l_start, r_start // {DAY} * {DAY} + {DAY} AS l_end FROM e)"""


def chunks(spark, sf):
    e = load(spark, sf, "events").withColumn("r_start", micros("ts"))
    return e.select("user_id", F.col("event_id").alias("chunk_id"), "event_type", "r_start", (F.col("r_start") + (F.col("event_id") % 50 + 1) * 60_000_000).alias("r_end"), ((F.col("event_id") % 101) / 100.0).alias("conf"))


def days(c):
    day = F.floor(F.col("r_start") / DAY)
    return c.select("user_id", day.alias("pos")).distinct().withColumns({"l_start": F.col("pos") * DAY, "l_end": F.col("pos") * DAY + DAY})


def timed(spark, sf):
    """Events as rows with start and end in microseconds, for folds."""
    return chunks(spark, sf).select("user_id", "chunk_id", F.col("r_start").alias("start"), F.col("r_end").alias("end"))


@query("interval_argmax_assign", f"""WITH {CHUNKS}, p AS (
  SELECT s.user_id, s.pos, e.chunk_id, e.event_type, e.r_start, e.conf, least(l_end, r_end) - greatest(l_start, r_start) AS ov FROM s JOIN e ON s.user_id = e.user_id AND s.l_start < e.r_end AND e.r_start < s.l_end
), a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id, chunk_id ORDER BY ov DESC, pos) = 1)
SELECT s.user_id, s.pos, count(a.chunk_id) AS n_chunks, string_agg(a.event_type, ' ' ORDER BY a.r_start, a.chunk_id) AS text, round(sum(a.conf * a.ov) / sum(a.ov), 6) AS confidence
FROM s LEFT JOIN a ON s.user_id = a.user_id AND s.pos = a.pos GROUP BY s.user_id, s.pos""")
def interval_argmax_assign(spark, sf):
    c = chunks(spark, sf)
    s = days(c)
    got = intervals.assign_by_overlap(s, c, ["user_id"], DAY)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start", "chunk_id", "event_type"))), lambda x: x["event_type"]), " ")
    made = got.groupBy("user_id", "pos").agg(F.count("*").alias("n_chunks"), texts.alias("text"), F.round(intervals.weighted_mean(F.col("conf"), F.col("overlap")), 6).alias("confidence"))
    return s.select("user_id", "pos").join(made, ["user_id", "pos"], "left").select("user_id", "pos", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "text", "confidence")


@query("interval_overlap_dominant", f"""WITH {CHUNKS}, p AS (
  SELECT s.user_id, s.pos, e.event_type, sum(least(l_end, r_end) - greatest(l_start, r_start)) AS amount FROM s JOIN e ON s.user_id = e.user_id AND s.l_start < e.r_end AND e.r_start < s.l_end GROUP BY ALL
), t AS (SELECT *, amount / sum(amount) OVER (PARTITION BY user_id, pos) AS share FROM p),
k AS (SELECT *, count(*) OVER (PARTITION BY user_id, pos) AS n_keys FROM t WHERE share >= 0.2)
SELECT user_id, pos, event_type, CAST(amount AS BIGINT) AS amount, round(share, 6) AS share, n_keys, CASE WHEN share >= 0.5 THEN event_type END AS verdict
FROM k QUALIFY row_number() OVER (PARTITION BY user_id, pos ORDER BY amount DESC, event_type DESC) = 1""")
def interval_overlap_dominant(spark, sf):
    c = chunks(spark, sf)
    met = intervals.overlap_join(days(c), c, ["user_id"], DAY)
    total = F.sum("overlap").over(W.partitionBy("user_id", "pos"))
    out = intervals.dominant(met.withColumn("total", total), ["user_id", "pos"], "event_type", "overlap", F.col("total"))
    return out.select("user_id", "pos", "event_type", F.col("amount").cast("long").alias("amount"), F.round("share", 6).alias("share"), "n_keys", "verdict")


@query("point_in_interval_last_closed", f"""WITH {CHUNKS}, r AS (SELECT user_id, min(r_start) AS lo, max(r_start) AS hi FROM e GROUP BY 1),
p AS (SELECT user_id, part, lo + (hi - lo) // 4 * part AS l_start, CASE WHEN part = 3 THEN hi ELSE lo + (hi - lo) // 4 * (part + 1) END AS l_end, part = 3 AS is_last FROM r, generate_series(0, 3) t(part))
SELECT p.user_id, p.part, count(e.chunk_id) AS n, count(e.chunk_id) FILTER (conf < 0.5) AS n_low FROM p LEFT JOIN e ON p.user_id = e.user_id AND e.r_start >= l_start AND (e.r_start < l_end OR (is_last AND e.r_start = l_end)) GROUP BY 1, 2""")
def point_in_interval_last_closed(spark, sf):
    c = chunks(spark, sf)
    r = c.groupBy("user_id").agg(F.min("r_start").alias("lo"), F.max("r_start").alias("hi"))
    step = F.expr("(hi - lo) div 4")
    parts = r.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("is_last", F.col("part") == 3)
    parts = parts.select("user_id", F.col("part").cast("long").alias("part"), (F.col("lo") + step * F.col("part")).alias("l_start"), F.when(F.col("is_last"), F.col("hi")).otherwise(F.col("lo") + step * (F.col("part") + 1)).alias("l_end"), "is_last")
    met = intervals.part_of_point(c.withColumn("at", F.col("r_start")), parts, ["user_id"], 30 * DAY)
    n = met.groupBy("user_id", "part").agg(F.count("*").alias("n"), F.count_if(F.col("conf") < 0.5).alias("n_low"))
    return parts.select("user_id", "part").join(n, ["user_id", "part"], "left").select("user_id", "part", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_low", F.lit(0)).alias("n_low"))


ISLANDS = f"""{CHUNKS}, g AS (SELECT *, max(r_end) OVER (PARTITION BY user_id ORDER BY r_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR r_start - reach > {4 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY r_start, chunk_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
b AS (SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(r_start) AS l_start, max(r_end) AS l_end FROM i GROUP BY ALL)"""


def islands_of(spark, sf):
    got = sequences.islands(chunks(spark, sf), ["user_id"], "r_start", "r_end", 4 * HOUR, ["r_start", "chunk_id"])
    return got.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("r_start").alias("l_start"), F.max("r_end").alias("l_end"))


@query("gap_islands", f"WITH {ISLANDS} SELECT * FROM b")
def gap_islands(spark, sf):
    return islands_of(spark, sf)


@query("split_long_islands", f"""WITH {ISLANDS}, n AS (SELECT *, CAST(greatest(1, ceil((l_end - l_start) / {1.0 * HOUR})) AS INT) AS n_parts FROM b)
SELECT user_id, island, part, n_parts, round(l_start + (l_end - l_start) / n_parts::DOUBLE * part, 0) AS l_start, round(l_start + (l_end - l_start) / n_parts::DOUBLE * (part + 1), 0) AS l_end FROM (SELECT *, CAST(unnest(generate_series(0, n_parts - 1)) AS INT) AS part FROM n)""")
def split_long_islands(spark, sf):
    got = sequences.split_long(islands_of(spark, sf), "l_start", "l_end", HOUR)
    return got.select("user_id", "island", "part", "n_parts", F.round("l_start", 0).alias("l_start"), F.round("l_end", 0).alias("l_end"))


@query("neighbor_context_arrays", """SELECT conv_id, turn, coalesce(string_agg(turn::VARCHAR || ':' || role, ',') OVER a, '') AS before, coalesce(string_agg(turn::VARCHAR || ':' || role, ',') OVER b, '') AS after
FROM conversations WINDOW a AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""")
def neighbor_context_arrays(spark, sf):
    value = F.concat_ws(":", F.col("turn").cast("string"), "role")
    got = sequences.neighbours(load(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], value, 2)
    return got.select("conv_id", "turn", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query("adjacent_pair_flags", """WITH p AS (SELECT *, coalesce(length(text) > length(lead(text) OVER w), false) AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, role, h OR coalesce(lag(h) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS flagged FROM p""")
def adjacent_pair_flags(spark, sf):
    test = lambda this, after: F.length(this("text")) > F.length(after("text"))
    return sequences.flag_pairs(load(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], test, "flagged").select("conv_id", "turn", "role", "flagged")


@query("fixed_batches", "SELECT source, b AS batch, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS b FROM documents) GROUP BY ALL")
def fixed_batches(spark, sf):
    got = sequences.batches(load(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 16)
    return got.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


FOLD = """WITH RECURSIVE {chunks}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r_start, chunk_id) AS k FROM e),
f AS (
  SELECT user_id, k, chunk_id, 0::BIGINT AS g, r_start AS first, r_end AS last, 1 AS n FROM o WHERE k = 1
  UNION ALL
  SELECT o.user_id, o.k, o.chunk_id, CASE WHEN {join} THEN g ELSE g + 1 END, CASE WHEN {join} THEN first ELSE o.r_start END, o.r_end, CASE WHEN {join} THEN n + 1 ELSE 1 END
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1
) SELECT user_id, chunk_id, g AS {out} FROM f"""


@query("greedy_span_groups", FOLD.format(chunks=CHUNKS, join=f"last - first < {6 * HOUR} AND o.r_start - last <= {8 * HOUR}", out="grp"))
def greedy_span_groups(spark, sf):
    return sequences.span_groups(timed(spark, sf), ["user_id"], ["start", "chunk_id"], 6 * HOUR, 8 * HOUR).select("user_id", "chunk_id", "grp")


@query("limit_batches", FOLD.format(chunks=CHUNKS, join=f"n < 5 AND o.r_end - first <= {2 * DAY} AND o.r_start - last <= {20 * HOUR}", out="batch"))
def limit_batches(spark, sf):
    return sequences.limit_batches(timed(spark, sf), ["user_id"], ["start", "chunk_id"], 5, 2 * DAY, 20 * HOUR).select("user_id", "chunk_id", "batch")


@query("numbered_rows", "SELECT user_id, event_id, printf('seg_%04d', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS row_id FROM events")
def numbered_rows(spark, sf):
    return sequences.number_rows(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "row_id")
