"""Statistics, histograms and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric_stats(df: DataFrame, by: list[str], value: str, digits: int = 6) -> DataFrame:
    """Count, least, p10, median, mean, p90, greatest (linear interpolation); null and non-finite values are passed over."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    made = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), q.alias("_q"), F.avg(v).alias("mean"), F.max(v).alias("greatest"))
    r = lambda c: F.round(c, digits)
    return made.select(*by, "n", r(F.col("least")).alias("least"), *[r(F.get("_q", F.lit(i))).alias(k) for i, k in enumerate(("p10", "median", "p90"))], r(F.col("mean")).alias("mean"), r(F.col("greatest")).alias("greatest"))


def dominant_share(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Most frequent key (of equal ones the smaller), its share, the number of keys and the share of rows without one."""
    n = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    named = F.when(F.col(key).isNotNull(), F.struct((-F.col("n")).alias("m"), F.col(key).alias("k")))
    missing = F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(0))
    out = n.groupBy(*by).agg(F.sum("n").alias("rows"), F.min(named).alias("_top"), missing.alias("_missing"), F.count(key).alias("n_keys"))
    return out.select(*by, "rows", F.col("_top.k").alias("top_key"), F.try_divide(-F.col("_top.m"), F.col("rows")).alias("top_share"), "n_keys", F.try_divide("_missing", "rows").alias("missing_share"))


def grade(clean: Column, quality: Column, noise: Column, share: Column, missing: Column) -> Column:
    """Ordered thresholds over aggregates: poor, excellent, good, or mixed."""
    return (
        F.when((clean < 30) | (quality < 0.5) | (missing > 0.5), "poor")
        .when((clean >= 600) & (quality >= 0.85) & (noise <= 0.1) & (share >= 0.9), "excellent")
        .when((clean >= 120) & (quality >= 0.7) & (share >= 0.3), "good")
        .otherwise("mixed")
    )


def histogram(df: DataFrame, by: list[str], status: str, values: list[str]) -> DataFrame:
    """One column for each status, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values])


def count_values(df: DataFrame, values: Column | str, out: str = "value") -> DataFrame:
    """Counts of the members of an array column (a scalar is wrapped by the caller)."""
    return df.select(F.explode(values).alias(out)).groupBy(out).agg(F.count("*").alias("n"))
