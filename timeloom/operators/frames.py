"""Measures of sampled signals. Samples are rows (clip, channel, pos, x); frames are made once and everything else is an aggregate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = -120.0


def db(level: Column) -> Column:
    """20 log10, not below the floor; null and 0 give the floor."""
    return F.when(level > 0, F.greatest(F.lit(FLOOR), 20 * F.log10(level))).otherwise(F.lit(FLOOR))


def to_frames(samples: DataFrame, clip: str, pos: str, x: str, size: int) -> DataFrame:
    """One row a frame of ``size`` samples: rms, peak and n. Frames of a long clip are summed before they are shuffled."""
    v = F.col(x).cast("double")
    return samples.groupBy(clip, F.floor(F.col(pos) / size).alias("frame")).agg(F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"), F.count(v).alias("n"))


def levels(samples: DataFrame, clip: str, x: str, clipped: float = 0.999) -> DataFrame:
    """Peak, rms (dB) and the share of samples at or above ``clipped``."""
    v = F.col(x).cast("double")
    got = samples.groupBy(clip).agg(F.max(F.abs(v)).alias("p"), F.sqrt(F.avg(v * v)).alias("r"), F.avg((F.abs(v) >= clipped).cast("int")).alias("clipping_ratio"))
    return got.select(clip, db(F.col("p")).alias("peak_dbfs"), db(F.col("r")).alias("rms_dbfs"), "clipping_ratio")


def silence(frames: DataFrame, clip: str, threshold_db: float) -> DataFrame:
    """Frames before the first active one and after the last, the share of active ones, and the ratio of the median levels (dB). Without an active frame all are leading."""
    active = db(F.col("rms")) > threshold_db
    got = frames.groupBy(clip).agg(
        F.count("*").alias("n_frames"), F.min(F.when(active, F.col("frame"))).alias("a"), F.max(F.when(active, F.col("frame"))).alias("b"), F.max("frame").alias("last"),
        F.avg(active.cast("int")).alias("active_ratio"), F.percentile(F.when(active, F.col("rms")), F.lit(0.5)).alias("loud"), F.percentile(F.when(~active, F.col("rms")), F.lit(0.5)).alias("quiet"),
    )
    return got.select(clip, "n_frames", F.coalesce("a", F.col("last") + 1).alias("leading"), F.coalesce(F.col("last") - F.col("b"), F.lit(0)).alias("trailing"), "active_ratio", (db(F.col("loud")) - db(F.col("quiet"))).alias("snr_db"))


def pan(left_rms: Column, right_rms: Column) -> Column:
    """-1 (left) to 1 (right); 0 for silence."""
    return F.coalesce(F.try_divide(right_rms - left_rms, right_rms + left_rms), F.lit(0.0))


def side_mid_db(left: str, right: str) -> Column:
    """Level of the difference against that of the sum, over the rows of a group."""
    mid, side = (F.col(left) + F.col(right)) / 2, (F.col(left) - F.col(right)) / 2
    return db(F.sqrt(F.avg(side * side))) - db(F.sqrt(F.avg(mid * mid)))
