"""Gates that keep every failing reason, in order and once each, instead of a bare verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(*checks: tuple[Column, str | Column]) -> Column:
    """(condition, reason) pairs to an array of the reasons whose condition holds; null conditions do not."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, r if isinstance(r, Column) else F.lit(r)) for c, r in checks])))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds, or null."""
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in checks], F.lit(None).cast("string"))


def gate(df: DataFrame, *checks: tuple[Column, str | Column], out: str = "reasons") -> DataFrame:
    """Adds the reasons and ``accepted``."""
    return df.withColumn(out, reasons(*checks)).withColumn("accepted", F.size(out) == 0)


def reason_counts(df: DataFrame, column: str = "reasons") -> DataFrame:
    """Counts by reason key, which is what stands before the first colon."""
    each = df.select(F.explode(column).alias("r"))
    return each.groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))
