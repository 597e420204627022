"""Signals: the numbers of an embedding stand in for a clip's samples."""

from pyspark.sql import functions as F

from timeloom.operators import frames
from timeloom.plans.catalog import query
from timeloom.sources.tables import load

SAMPLES = "s AS (SELECT vec_id, i - 1 AS pos, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"
DB = "CASE WHEN {0} > 0 THEN greatest(-120.0, 20 * log10({0})) ELSE -120.0 END"


def samples(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@query("signal_levels", f"""WITH {SAMPLES}, g AS (SELECT vec_id, max(abs(x)) AS p, sqrt(avg(x * x)) AS r, avg(CASE WHEN abs(x) >= 0.2 THEN 1 ELSE 0 END) AS c FROM s GROUP BY 1)
SELECT vec_id, round({DB.format('p')}, 5) AS peak_dbfs, round({DB.format('r')}, 5) AS rms_dbfs, round(c, 6) AS clipping_ratio FROM g""")
def signal_levels(spark, sf):
    got = frames.levels(samples(spark, sf), "vec_id", "x", 0.2)
    return got.select("vec_id", F.round("peak_dbfs", 5).alias("peak_dbfs"), F.round("rms_dbfs", 5).alias("rms_dbfs"), F.round("clipping_ratio", 6).alias("clipping_ratio"))


@query("frame_silence", f"""WITH {SAMPLES}, f AS (SELECT vec_id, pos // 8 AS frame, sqrt(avg(x * x)) AS rms FROM s GROUP BY ALL), a AS (SELECT *, {DB.format('rms')} > -18.5 AS active FROM f),
g AS (SELECT vec_id, count(*) AS n_frames, min(frame) FILTER (active) AS a, max(frame) FILTER (active) AS b, max(frame) AS last, avg(CASE WHEN active THEN 1 ELSE 0 END) AS active_ratio, quantile_cont(rms, 0.5) FILTER (active) AS loud, quantile_cont(rms, 0.5) FILTER (NOT active) AS quiet FROM a GROUP BY 1)
SELECT vec_id, round({DB.format('coalesce(loud, 0)')} - {DB.format('coalesce(quiet, 0)')}, 4) AS snr_db, n_frames, coalesce(a, last + 1) AS leading, coalesce(last - b, 0) AS trailing, round(active_ratio, 6) AS active_ratio FROM g""")
def frame_silence(spark, sf):
    got = frames.silence(frames.to_frames(samples(spark, sf), "vec_id", "pos", "x", 8), "vec_id", -18.5)
    return got.select("vec_id", F.round("snr_db", 4).alias("snr_db"), "n_frames", "leading", "trailing", F.round("active_ratio", 6).alias("active_ratio"))


@query("stereo_measures", f"""WITH {SAMPLES}, p AS (SELECT vec_id, pos // 2 AS k, max(CASE WHEN pos % 2 = 0 THEN x END) AS l, max(CASE WHEN pos % 2 = 1 THEN x END) AS r FROM s GROUP BY ALL),
g AS (SELECT vec_id, sqrt(avg(l * l)) AS lr, sqrt(avg(r * r)) AS rr, sqrt(avg((l - r) * (l - r) / 4)) AS side, sqrt(avg((l + r) * (l + r) / 4)) AS mid FROM p GROUP BY 1)
SELECT vec_id, round(coalesce((rr - lr) / nullif(rr + lr, 0), 0), 6) AS pan, round({DB.format('side')} - {DB.format('mid')}, 5) AS side_mid_db FROM g""")
def stereo_measures(spark, sf):
    s = samples(spark, sf)
    pairs = s.groupBy("vec_id", F.floor(F.col("pos") / 2).alias("k")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("x"))).alias("l"), F.max(F.when(F.col("pos") % 2 == 1, F.col("x"))).alias("r"))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    got = pairs.groupBy("vec_id").agg(rms("l").alias("lr"), rms("r").alias("rr"), frames.side_mid_db("l", "r").alias("sm"))
    return got.select("vec_id", F.round(frames.pan(F.col("lr"), F.col("rr")), 6).alias("pan"), F.round("sm", 5).alias("side_mid_db"))
