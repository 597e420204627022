"""Sequences of numbers, gates and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(values: Column | str) -> Column:
    """Differences of neighbours."""
    v = F.col(values) if isinstance(values, str) else values
    return F.when(F.size(v) < 2, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: a - b))


def is_countdown(values: Column | str, least: int = 3) -> Column:
    v = F.col(values) if isinstance(values, str) else values
    return (F.size(v) >= least) & F.forall(steps(v), lambda d: d == -1)


def is_monotonic(values: Column | str) -> Column:
    """Every step is +1, or every step is -1."""
    s = steps(values)
    return (F.size(s) > 0) & (F.forall(s, lambda d: d == 1) | F.forall(s, lambda d: d == -1))


def missing_values(expected: str, observed: str) -> Column:
    """Expected values that a greedy scan through the observed ones does not meet; once a value is missing the scan is used up."""
    e, o = F.col(expected), F.col(observed)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        rest = F.slice(o, acc["at"] + 1, F.greatest(F.size(o) - acc["at"], F.lit(0)))
        k = F.array_position(rest, v).cast("int")
        return F.struct(F.when(k > 0, acc["at"] + k).otherwise(F.size(o)).alias("at"), F.when(k > 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(v))).alias("out"))

    return F.aggregate(e, start, step, lambda acc: acc["out"])


def contains_run(whole: str, part: str) -> Column:
    """Whether ``part`` stands in ``whole`` without gaps; an empty part does."""
    w, p = F.col(whole), F.col(part)
    n = F.size(w) - F.size(p) + 1
    return F.when(F.size(p) == 0, True).when(n < 1, False).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(w, i, F.size(p)) == p))


def duration_policy(source: Column, output: Column) -> Column:
    """Short sources have an absolute tolerance (seconds), longer ones a ratio: struct of limit, ratio, verdict."""
    tolerance = F.when(source < 0.7, 0.22).when(source < 1.2, 0.30).when(source < 2.0, 0.40)
    off, ratio = output - source, F.try_divide(output, source)
    by_off = F.when(off > tolerance, "too_long").when(off < -tolerance, "too_short").otherwise("pass")
    by_ratio = F.when(ratio > 1.35, "too_long").when(ratio < 0.75, "too_short").otherwise("pass")
    verdict = F.when(source.isNull() | output.isNull() | (source <= 0), "unknown").when(tolerance.isNotNull(), by_off).otherwise(by_ratio)
    return F.struct(tolerance.alias("tolerance"), ratio.alias("ratio"), verdict.alias("verdict"))


def clamp(value: Column, low: float, high: float) -> Column:
    """Within bounds; null stays null (least and greatest alone would pass it over)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def soft_upper_penalty(value: Column, preferred: float, hard: float, most: float) -> Column:
    """0 up to ``preferred``, rising in a line to ``most`` at ``hard``; null counts as 0."""
    return F.coalesce(clamp((value - preferred) / (hard - preferred), 0.0, 1.0) * most, F.lit(0.0))


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def norm(vector: Column | str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def char_budget(seconds: Column, source_chars: Column, per_second: float = 4.0) -> Column:
    """Characters that fit: those of the source if known, else a rate; at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.when(source_chars > 0, source_chars), F.floor(seconds * per_second))).cast("int")


def next_speed(speed: Column, actual: Column, target: Column, most: float = 2.0, step: float = 0.05) -> Column:
    """The speed for another try: scaled by how far the last one was off, at least one step up when it was too long, 4 digits."""
    scaled = speed * F.coalesce(F.try_divide(actual, F.when(target > 0, target)), F.lit(1.0))
    return F.round(clamp(F.when(actual > target, F.greatest(scaled, speed + step)).otherwise(scaled), 0.5, most), 4)


def tempo_steps(tempo: Column) -> Column:
    """A tempo as a product of factors within 0.5 and 2, as few as possible: full halvings or doublings first."""
    n = F.when(tempo > 2, F.floor(F.log2(tempo / 2) + 0.9999999)).when(tempo < 0.5, F.floor(F.log2(0.5 / tempo) + 0.9999999)).otherwise(0).cast("int")
    whole = F.when(tempo > 2, 2.0).otherwise(0.5)
    return F.concat(F.array_repeat(whole, n), F.array(tempo / F.pow(whole, n)))
