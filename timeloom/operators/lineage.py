"""Stage state: stale rows, invalidation downstream of a stage, signatures of failures, and maps followed to their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.operators.reasons import reasons
from timeloom.sources.scratch import settled


def stale_reasons(pairs: list[tuple[str, Column, Column]]) -> Column:
    """(name, found, expected): a null expectation switches its check off; a null id is missing, another one is stale."""
    checks = []
    for name, found, expected in pairs:
        checks.append((expected.isNotNull() & found.isNull(), f"missing_{name}"))
        checks.append((expected.isNotNull() & (found != expected), f"stale_{name}"))
    return reasons(*checks)


def downstream(nodes: list[str], first: str) -> list[str]:
    """``first`` and all that follows it in a linear order of stages."""
    return nodes[nodes.index(first) :]


def invalidate(df: DataFrame, nodes: list[str], node_of_row: Column) -> DataFrame:
    """Nulls the columns (one a stage, named like it) from each row's node on; adds ``invalidated``, their names in order. A null node changes nothing."""
    place = F.coalesce(*[F.when(node_of_row == n, F.lit(i)) for i, n in enumerate(nodes)], F.lit(len(nodes)))
    df = df.withColumn("_at", place)
    gone = F.array_compact(F.array(*[F.when((F.col("_at") <= i) & F.col(n).isNotNull(), F.lit(n)) for i, n in enumerate(nodes)]))
    df = df.withColumn("invalidated", gone)
    return df.withColumns({n: F.when(F.col("_at") > i, F.col(n)) for i, n in enumerate(nodes)}).drop("_at")


def signature(issues: Column | str) -> Column:
    """Distinct issues, sorted and joined: rows that fail alike have it in common."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(issues))), "|")


def ends(at: DataFrame) -> DataFrame:
    """(s, t) doubled until no chain goes on: as many rounds as the logarithm of the longest chain. On cycles it would not end, so it stops after those that all rows could need."""
    rounds = max(1, at.count().bit_length())
    for _ in range(rounds + 1):
        nxt = at.select(F.col("s").alias("s2"), F.col("t").alias("t2"))
        met = at.join(nxt, (F.col("t") == F.col("s2")) & (F.col("s") != F.col("t")), "left")
        at = settled(met.select("s", F.coalesce("t2", "t").alias("t"), (F.col("t2").isNotNull() & (F.col("t2") != F.col("t"))).alias("moved")), "follow")
        if not at.where("moved").limit(1).count():
            break
        at = at.select("s", "t")
    return at.select("s", "t")


def follow(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Every source with the end of its chain of edges (one a source), however long. A chain that runs into a cycle ends where it enters it; a node of a cycle stays itself."""
    at = settled(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null"), "edges")
    done = ends(at)
    # what is reached by so many steps and still goes on lies on a cycle
    on_cycle = settled(done.select(F.col("t").alias("c")).distinct().join(at.where("s <> t").select(F.col("s").alias("c")), "c", "left_semi"), "cycles")
    if on_cycle.limit(1).count():
        done = ends(at.join(on_cycle, F.col("s") == F.col("c"), "left").select("s", F.when(F.col("c").isNotNull(), F.col("s")).otherwise(F.col("t")).alias("t")))
    return done.select(F.col("s").alias(source), F.col("t").alias(target))


def latest(df: DataFrame, by: list[str], order: Column, *values: str) -> DataFrame:
    """The latest record of each key from an append-only table."""
    return df.groupBy(*by).agg(*[F.max_by(v, order).alias(v) for v in values])


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and the first 20 hex digits of the parts' sha-256; null parts count as empty."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 20))
