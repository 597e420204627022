"""Connected components by alternating large-star and small-star steps, all as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import stage

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), long: node, component (its smallest node) for every node of an edge. Loops and repeated edges do no harm.

    Both steps keep the components and shorten every path to the smallest node; log-many rounds end in stars. Each round is written
    to the shared folder. Null ends are passed over; no edges give no rows.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, "graph-edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        keep = e.join(least, "u").select("u", F.col("m").alias("v"))  # u's own link to its least neighbour
        e1 = large.unionByName(keep).where("u != v").distinct()
        small = e1.groupBy("u").agg(F.min("v").alias("m"))
        e2 = e1.join(small, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = stage(e2, "graph-edges")
        now = e.agg(F.count("u"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0))).first()
        if before == now:
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
        before = now
    raise RuntimeError("components did not settle")
