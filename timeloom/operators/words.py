"""Operators on rows that carry timed words: array<struct<start, end, text, confidence>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift(words: Column | str, by: Column) -> Column:
    return F.transform(words, lambda w: w.withField("start", w["start"] + by).withField("end", w["end"] + by))


def clip(words: Column | str, start: Column, end: Column) -> Column:
    """Words whose middle lies in the window, cut to it."""
    inside = F.filter(words, lambda w: ((w["start"] + w["end"]) / 2 >= start) & ((w["start"] + w["end"]) / 2 <= end))
    return F.transform(inside, lambda w: w.withField("start", F.greatest(w["start"], start)).withField("end", F.least(w["end"], end)))


def extent(words: Column | str) -> Column:
    """First start and last end; nulls for no words."""
    return F.struct(F.array_min(F.transform(words, lambda w: w["start"])).alias("start"), F.array_max(F.transform(words, lambda w: w["end"])).alias("end"))


def tighten(start: Column, end: Column, words: str, pad: float, least_gain: float) -> Column:
    """A row's times drawn in to its words and ``pad`` around them, unless that gains less than a share of its length."""
    e = extent(words)
    s, t = F.greatest(start, e["start"] - pad), F.least(end, e["end"] + pad)
    gain = F.try_divide((end - start) - (t - s), end - start)
    worth = F.coalesce(gain >= least_gain, F.lit(False))
    return F.struct(F.when(worth, s).otherwise(start).alias("start"), F.when(worth, t).otherwise(end).alias("end"))


def split_at_gaps(words: str, gap: float) -> Column:
    """Words (in order) as array of arrays: a new one begins after a gap of at least ``gap``."""
    n = F.size(words)
    opens = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (F.get(words, i)["start"] - F.get(words, i - 1)["end"] >= gap))
    ends = F.concat(F.slice(opens, 2, F.size(opens)), F.array(n))
    return F.when(n > 0, F.zip_with(opens, ends, lambda a, b: F.slice(words, a + 1, b - a))).otherwise(F.when(n == 0, F.slice(F.array(F.col(words)), 1, 0)))


def join_text(words: Column | str) -> Column:
    """Texts joined; a space stands only where a neighbour has an ASCII letter or digit."""
    plain = lambda t: F.regexp_like(t, F.lit("[A-Za-z0-9]"))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"))
    step = lambda a, w: F.struct(F.concat(a["out"], F.when((a["out"] != "") & (plain(a["last"]) | plain(w["text"])), " ").otherwise(""), w["text"]).alias("out"), w["text"].alias("last"))
    return F.aggregate(words, start, step, lambda a: a["out"])
