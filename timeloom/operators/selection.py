"""Ranking, budgets and de-duplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeloom.functions.text import compare_key


def top(df: DataFrame, by: list[str], *order: Column, k: int = 1) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def budget_prefix(df: DataFrame, by: list[str], order: list[Column], cost: str, target: float) -> DataFrame:
    """Rows in order until the running total reaches the target; the row that crosses it is kept."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("running", F.sum(cost).over(w)).where(F.col("running") - F.col(cost) < target)


def budget_skip(df: DataFrame, by: list[str], order: list[str], cost: str, cap: float, least: float = 0.0) -> DataFrame:
    """Rows in order of ``order`` (ascending); one that would pass the cap is left out once ``least`` is reached, later ones may still fit. Adds ``kept``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", kept boolean"
    limit = max(cap, least)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        total, kept = 0.0, []
        for c in pdf[cost]:
            ok = not (total >= least and total + c > limit)
            kept.append(ok)
            total += c if ok else 0
        return pdf.assign(kept=kept)

    return df.groupBy(*by).applyInPandas(run, schema)


def keep_best(df: DataFrame, by: list[str], *order: Column, ident: str) -> DataFrame:
    """Adds ``kept_id``, the first row of each group, and ``reason`` for the others."""
    first = F.first(ident).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    df = df.withColumn("kept_id", first)
    return df.withColumn("reason", F.when(F.col(ident) != F.col("kept_id"), F.concat(F.lit("duplicate_of:"), F.col("kept_id").cast("string"))))


def first_equal_text(df: DataFrame, candidates: DataFrame, ident: str) -> DataFrame:
    """Adds the first candidate (least ``ident``) whose whole normalised text equals the row's, or null; texts that are empty then match nothing."""
    key = compare_key(F.col("text"))
    first = candidates.select(key.alias("_k"), ident).where("_k <> ''").groupBy(F.sha2("_k", 256).alias("_h")).agg(F.min(ident).alias(ident))  # one row a text
    return df.drop(ident).withColumn("_h", F.sha2(key, 256)).join(first, "_h", "left").drop("_h")


def near_duplicates(df: DataFrame, key: str, size: str, ident: str, absolute: float, relative: float) -> DataFrame:
    """Rows with the key of a larger one (the representative) and a size within an absolute or relative tolerance of it."""
    w = W.partitionBy(key).orderBy(F.desc(size), F.asc(ident)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumns({"rep_id": F.first(ident).over(w), "rep_size": F.first(size).over(w)})
    off = F.abs(F.col("rep_size") - F.col(size))
    return df.withColumn("near_duplicate", (F.col(ident) != F.col("rep_id")) & (off <= F.greatest(F.lit(absolute), F.col("rep_size") * relative)))


def missing_numbers(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Numbers from the group's least to its greatest that it lacks."""
    got = df.groupBy(*by).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.collect_set(number).alias("present"))
    return got.withColumn("missing", F.array_except(F.sequence("lo", "hi"), F.col("present"))).drop("present")


def vote(df: DataFrame, by: list[str], key: str, score: str, ident: str, least: int = 2) -> DataFrame:
    """Groups of equal keys vote: most votes, then best score, then key; the winner's best row is returned if it has enough votes."""
    votes = df.groupBy(*by, key).agg(F.count("*").alias("votes"), F.max(score).alias("best_score"), F.max_by(ident, F.struct(F.col(score), -F.col(ident))).alias("winner"))
    return top(votes, by, F.desc("votes"), F.desc("best_score"), F.asc(key)).where(F.col("votes") >= least)
