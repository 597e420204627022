"""Gates over patterns, whole projects, policies and paths."""

from __future__ import annotations

import os
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_pattern(p: str) -> bool:
    """Whether the engine that will run a pattern takes it."""
    session = SparkSession.getActiveSession()
    if session is None or not hasattr(session, "_jvm"):
        try:
            return bool(re.compile(p))
        except re.error:
            return False
    try:
        session._jvm.java.util.regex.Pattern.compile(p)
        return True
    except (IllegalArgumentException, Py4JJavaError):
        return False


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    """The patterns that a text matches, in order and once each; one that is no valid regular expression is looked for as it stands. Blank ones are left out."""
    names = list(dict.fromkeys(p.strip() for p in patterns if p.strip()))
    checks = [F.when(F.regexp_like(text, F.lit(p)) if is_pattern(p) else text.contains(p), F.lit(p)) for p in names]
    return F.array_compact(F.array(*checks)) if checks else F.slice(F.array(F.lit("")), 1, 0)


def classify(text: Column, markers: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The first class of which any marker occurs in the lower-cased text; null if none."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, parts in reversed(markers):
        hit = F.lit(False)
        for part in parts:
            hit = hit | low.contains(part)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def without_moot(reasons: str, accepted: Column, moot: list[str]) -> Column:
    """Reasons less those that a later acceptance makes moot."""
    return F.when(accepted, F.array_except(reasons, F.array(*map(F.lit, moot)))).otherwise(F.col(reasons))


def has_reason(reasons: str, exact: list[str], prefixes: list[str]) -> Column:
    hit = lambda r: r.isin(exact) | (F.regexp_like(r, F.lit("^(" + "|".join(map(re.escape, prefixes)) + ")")) if prefixes else F.lit(False))
    return F.exists(reasons, hit)


def readiness(df: DataFrame, by: list[str], blocked: Column, ident: str) -> DataFrame:
    """Per project: ready if nothing blocks, and the ids that do (sorted)."""
    ids = F.sort_array(F.collect_list(F.when(blocked, F.col(ident))))
    return df.groupBy(*by).agg(F.count("*").alias("n"), ids.alias("blocking")).withColumn("ready", F.size("blocking") == 0)


def policy_gate(df: DataFrame, policy: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key the policy table allows. The gate is closed: without a table the job is refused, and an unknown key is not allowed.

    policy(key, allowed).
    """
    if policy is None:
        raise PermissionError("a policy table is required; without one nothing passes")
    ok = policy.groupBy(key).agg(F.min(F.coalesce("allowed", F.lit(False))).alias("_ok")).where("_ok").select(key)
    return df.join(ok, key, "left_semi")


def inside(root: str, path: str) -> str:
    """The path, if it lies in ``root`` after links and dots are resolved; else an error."""
    real, top = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if os.path.commonpath([real, top]) != top:
        raise ValueError(f"{path} leads out of {root}")
    return real


def decide(rules: list[tuple[Column, str, str]], attempts: Column, most: int) -> Column:
    """Ordered rules (condition, action, stage) to struct<action, stage, terminal>; at ``most`` attempts every action ends in review."""
    action, stage = F.lit("none"), F.lit(None).cast("string")
    for when, name, where in reversed(rules):
        action, stage = F.when(when, name).otherwise(action), F.when(when, where).otherwise(stage)
    spent = (action != "none") & (attempts >= most)
    return F.struct(F.when(spent, "manual_review").otherwise(action).alias("action"), F.when(~spent, stage).alias("stage"), (spent | (action == "none")).alias("terminal"))
