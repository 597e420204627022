"""Joins of half-open intervals [start, end) by overlap, as equi-joins on time buckets.

Both sides are copied to the buckets that they touch; a pair is kept only in the first bucket that both share, so no distinct is needed. The bucket
width should be near the length of the longer side's typical interval. Keys keep projects apart and spread the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucketed(df: DataFrame, start: str, end: str, width: float, name: str) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.greatest(F.ceil(F.col(end) / width) - 1, F.floor(F.col(start) / width))
    return df.withColumn(f"_{name}", first).withColumn("_bucket", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, how: str = "inner") -> DataFrame:
    """left(keys, l_start, l_end, ...), right(keys, r_start, r_end, ...): pairs with a positive ``overlap``."""
    a, b = bucketed(left, "l_start", "l_end", width, "l"), bucketed(right, "r_start", "r_end", width, "r")
    met = a.join(b, [*keys, "_bucket"]).where((F.col("_bucket") == F.greatest("_l", "_r")) & (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))
    return met.withColumn("overlap", F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).where("overlap > 0").drop("_bucket", "_l", "_r")


def best(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def assign_by_overlap(segments: DataFrame, chunks: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Each chunk (chunk_id, r_start, r_end) goes to the one segment (pos, l_start, l_end) with the largest overlap, of equal ones to the first."""
    return best(overlap_join(segments, chunks, keys, width), [*keys, "chunk_id"], F.desc("overlap"), F.asc("pos"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean that passes over null values; null if the weights sum to 0 or less."""
    w = F.when(value.isNotNull(), weight)
    return F.when(F.sum(w) > 0, F.try_divide(F.sum(value * w), F.sum(w)))


def dominant(df: DataFrame, by: list[str], key: str, amount: str, total: Column, least: float = 0.2, most: float = 0.5) -> DataFrame:
    """Amounts summed by key; keys below ``least`` of the total are out; the largest rules if it has ``most`` of it; of equal ones the larger key."""
    sums = df.groupBy(*by, key).agg(F.sum(amount).alias("amount"), F.first(total).alias("_total"))
    kept = sums.withColumn("share", F.try_divide("amount", "_total")).where(F.col("share") >= least)
    win = W.partitionBy(*by)
    top = kept.withColumn("n_keys", F.count("*").over(win))
    top = best(top, by, F.desc("amount"), F.desc(key))
    return top.withColumn("verdict", F.when(F.col("share") >= most, F.col(key))).drop("_total")


def part_of_point(points: DataFrame, parts: DataFrame, keys: list[str], width: float) -> DataFrame:
    """points(keys, at), parts(keys, part, l_start, l_end, is_last): the part [start, end) of each point; the last part includes its end."""
    a = bucketed(parts.withColumn("l_reach", F.when(F.col("is_last"), F.col("l_end") + 1).otherwise(F.col("l_end"))), "l_start", "l_reach", width, "l")
    b = points.withColumn("_bucket", F.floor(F.col("at") / width))
    inside = (F.col("at") >= F.col("l_start")) & ((F.col("at") < F.col("l_end")) | (F.col("is_last") & (F.col("at") == F.col("l_end"))))
    return b.join(a, [*keys, "_bucket"]).where(inside).drop("_bucket", "_l", "l_reach")
