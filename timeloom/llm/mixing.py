"""Mixing sources to target weights: temperature mixing and budgeted block permutations.

A source's weight is its share of all tokens to the power alpha, normalised. alpha is found by bisection: the smallest in [0, 1] at which the
weights' entropy is down to the target or, without a target, at which no source is repeated more often than the limit. Weights times the
budget are the sources' tokens in the mix. Every source's documents are permuted by a keyed hash and dealt over blocks of bounded
size; whole epochs repeat all blocks, the last epoch takes blocks in order while the source's tokens last, and in the block where they end
documents in order. Blocks of all sources are then placed by the share of their source that precedes them, so that the mix is even all along.

By default the budget is the least that keeps every document at least once: the source with the least weight to its tokens is taken once.

Sizes. The exponent is bisected by aggregates over one row a source, many exponents in a pass, so sources may be many. All else is joins and windows over blocks, whose number of rows is
``BLOCK_ROWS`` on average, so no source, however large, meets in one task. Rows that are equal are placed one by one. Only DataFrame operations are used.

Defined cases. A null source is a source of its own; a null text has no tokens and goes with its block. A source without tokens has weight 0, and
its documents come once if the budget is not given. Repeated rows and ties are ordered by the hash of their whole row, and what is equal in that is
interchangeable. An empty table gives no rows. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeloom.llm.common import fresh, stage, table, words

LIMIT = 4.0
BLOCK_ROWS = 2000
GROUP = 1024  # blocks whose sums are put together first
SEED = 11


def weights(tokens: list[float], alpha: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** alpha if t > 0 else 0.0 for t in tokens]
    return [r / sum(raw) for r in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def repeats(tokens: list[float], w: list[float], budget: float | None) -> float:
    """How often the most repeated source is read; without a budget, when the least repeated one is read once."""
    rate = [x / t for x, t in zip(w, tokens) if t > 0]
    return max(rate) * budget if budget is not None else max(rate) / min(rate)


def solve(tokens: list[float], target_entropy: float | None = None, limit: float | None = LIMIT, budget: float | None = None) -> float:
    """The exponent; entropy falls and repetition falls as it grows from 0 (even) to 1 (as the corpus is)."""
    if sum(t > 0 for t in tokens) < 2:
        return 1.0

    def low_enough(alpha: float) -> bool:
        w = weights(tokens, alpha)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        return limit is None or repeats(tokens, w, budget) <= limit

    if low_enough(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if low_enough(mid) else (mid, hi)
    return hi


#: Exponents tried in one pass over the sources, and passes; together they bisect [0, 1] as finely as 36 halvings.
GRID, PASSES = 64, 6


def measures(sources: DataFrame, alphas: list[float], target_entropy: float | None, limit: float | None, budget: float | None) -> list[tuple[float, float, float, bool]]:
    """For each exponent: the sum of powers, the least power by token, and whether it is low enough. Aggregates over the sources, however many there are."""
    each = sources.where("tokens > 0").select("tokens", (F.col("tokens") / F.col("total")).alias("share"), F.explode(F.lit(alphas)).alias("a"))
    p = F.pow("share", F.col("a"))
    sums = each.groupBy("a").agg(F.sum(p).alias("z"), F.sum(p * F.log("share")).alias("low"), F.max(p / F.col("tokens")).alias("high"), F.min(p / F.col("tokens")).alias("least"))
    found = {r.a: r for r in sums.collect()}  # one row an exponent
    out = []
    for a in alphas:
        z, low, high, least = (found[a][k] for k in ("z", "low", "high", "least"))
        if target_entropy is not None:
            ok = math.log(z) - a * low / z <= target_entropy
        else:
            ok = limit is None or (high / z * budget if budget is not None else high / least) <= limit
        out.append((z, least, high, ok))
    return out


def solve_table(sources: DataFrame, target_entropy: float | None, limit: float | None, budget: float | None) -> tuple[float, float, float]:
    """The exponent of ``solve``, the sum of powers there and the least power by token. sources(tokens, total), at least one with tokens."""
    tries = lambda alphas: measures(sources, alphas, target_entropy, limit, budget)
    lo, hi = 0.0, 1.0
    z, least, _, ok = tries([0.0])[0]
    if ok and sources.where("tokens > 0").limit(2).count() == 2:
        return 0.0, z, least
    if sources.where("tokens > 0").limit(2).count() == 2:
        for _ in range(PASSES):
            grid = [lo + (hi - lo) * (k + 1) / GRID for k in range(GRID)]
            first = next((k for k, m in enumerate(tries(grid)) if m[3]), GRID - 1)
            lo, hi = (grid[first - 1] if first else lo), grid[first]
    z, least, _, _ = tries([hi])[0]
    return hi, z, least


def mix(docs: DataFrame, target_entropy: float | None = None, limit: float | None = LIMIT, budget: float | None = None, n_tokens: Column | None = None) -> DataFrame:
    """docs: doc_id, text, source and more. Adds n_tokens, weight, block, position, epoch (from 0) and place; one row for each time a row is read."""
    docs = docs.drop("n_tokens", "weight", "epoch", "block", "position", "place")
    n_tokens = n_tokens if n_tokens is not None else F.size(words(F.col("text"))).cast("long")
    s, null, h, quota, every, blocks_, before, whole, left, run, copies = fresh(docs, "s", "null", "h", "quota", "all", "blocks", "before", "whole", "left", "run", "copies")
    source = [s, null]
    base = docs.withColumns({s: F.coalesce(F.col("source"), F.lit("")), null: F.col("source").isNull(), h: F.xxhash64(*docs.columns, F.lit(SEED)), "n_tokens": n_tokens})
    narrow = stage(base.select(s, null, h, "n_tokens"), "mix-rows")
    sources = stage(narrow.groupBy(*source).agg(F.sum("n_tokens").alias("tokens"), F.count("n_tokens").alias("n")), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    known = sources.withColumn("total", F.lit(float(max(total, 1))))
    alpha, z, least = solve_table(known, target_entropy, limit, budget) if total else (1.0, 1.0, 1.0)
    goal = budget if budget is not None else z / least
    has = F.col("tokens") > 0
    weight = F.when(has, F.pow(F.col("tokens") / F.col("total"), F.lit(alpha)) / z).otherwise(0.0)
    # a source's tokens in the mix, rounded up so that the source taken once is taken whole
    plan = known.select(*source, weight.alias("weight"), F.when(has, F.ceil(weight * goal - 1e-6)).otherwise(0).cast("long").alias(quota), F.col("tokens").alias(every), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long").alias(blocks_))
    block = F.pmod(F.col(h), F.col(blocks_)).alias("block")
    here = narrow.join(plan, source).select(*source, quota, every, block, "n_tokens").groupBy(*source, quota, every, "block").agg(F.sum("n_tokens").alias("here"))
    here = stage(here, "mix-blocks")
    # sums over what stands before a block, in two steps: no task has more than the blocks of a group or the groups of a source
    group = F.floor(F.col("block") / GROUP)
    groups = here.groupBy(*source, group.alias("group")).agg(F.sum("here").alias("of_group"))
    ahead = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select(*source, "group", F.coalesce(F.sum("of_group").over(ahead(W.partitionBy(*source).orderBy("group"))), F.lit(0)).alias("first"))
    inner = here.withColumn("group", group).withColumn("own", F.coalesce(F.sum("here").over(ahead(W.partitionBy(*source, "group").orderBy("block"))), F.lit(0)))
    some = F.col(every) > 0
    of_block = inner.join(groups, [*source, "group"]).select(*source, "block", (F.col("first") + F.col("own")).alias(before), F.when(some, F.floor(F.col(quota) / F.col(every))).otherwise(F.lit(1 if budget is None else 0)).alias(whole), F.when(some, F.col(quota) % F.col(every)).otherwise(0).alias(left))
    within = W.partitionBy(*source, "block").orderBy(h, "doc_id")
    dealt = base.join(plan.select(*source, "weight", blocks_), source).withColumn("block", block)
    placed = dealt.join(of_block, [*source, "block"]).withColumns({run: F.sum("n_tokens").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)), "position": F.row_number().over(within)})
    extra = (F.col(left) > 0) & (F.col(before) + F.col(run) <= F.col(left))
    chosen = placed.withColumn(copies, F.col(whole) + extra.cast("long")).where(F.col(copies) > 0)
    out = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    # the share of its source that lies before a block, over all its epochs: an order in which the sources advance together
    place = (F.col("epoch") + F.col("block") / F.col(blocks_)) / F.col(copies)
    return out.withColumn("place", place).select(*docs.columns, "n_tokens", "weight", "block", "position", "epoch", "place")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "position", "place")
