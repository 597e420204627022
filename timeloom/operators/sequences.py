"""Ordered operators: islands, batches, neighbours, and folds whose state begins with the group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: float, order: list[str]) -> DataFrame:
    """Adds ``island``: a new one begins where the gap to everything before is greater than ``gap``."""
    w = W.partitionBy(*keys).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col(start) - reach > gap)
    return df.withColumn("_o", opens.cast("int")).withColumn("island", F.sum("_o").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_o")


def split_long(df: DataFrame, start: str, end: str, most: float) -> DataFrame:
    """Intervals longer than ``most`` become equal parts; adds part and n_parts."""
    n = F.greatest(F.lit(1), F.ceil((F.col(end) - F.col(start)) / most)).cast("int")
    df = df.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    size = (F.col(end) - F.col(start)) / F.col("n_parts")
    return df.withColumns({start: F.col(start) + size * F.col("part"), end: F.col(start) + size * (F.col("part") + 1)})


def batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds ``batch``: rows in order, ``size`` at a time."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1) / size))


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: Column, radius: int) -> DataFrame:
    """Adds ``before`` and ``after``: the values of up to ``radius`` rows on either side, in order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"before": F.collect_list(value).over(w.rowsBetween(-radius, -1)), "after": F.collect_list(value).over(w.rowsBetween(1, radius))})


def flag_pairs(df: DataFrame, keys: list[str], order: list[str], test: Callable[[Callable, Callable], Column], out: str) -> DataFrame:
    """Adds ``out``: whether the row and its next, or its previous and the row, pass ``test(this, next)``: both rows of a pair are marked."""
    w = W.partitionBy(*keys).orderBy(*order)
    hit = F.coalesce(test(F.col, lambda c: F.lead(c).over(w)), F.lit(False))
    return df.withColumn("_h", hit).withColumn(out, F.col("_h") | F.coalesce(F.lag("_h").over(w), F.lit(False))).drop("_h")


def fold(df: DataFrame, keys: list[str], order: list[str], step: Callable, out: str = "grp") -> DataFrame:
    """Adds ``out``: group numbers by an ordered fold within each key. step(first row of the group, last row, size, row) says whether the row joins.

    For rules that look at the group's beginning, which no lag can see. Rows stream through sorted by key and order, and only a group's first and last row are held, so a key of any size
    fits; one key is one task. A null key is a key of its own.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` bigint"
    places = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, first, last, size = object(), -1, None, None, 0
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                mine = tuple(None if row[p] != row[p] else row[p] for p in places)
                if mine != key:
                    key, number, first, size = mine, 0, row, 1
                elif step(first, last, size, row):
                    size += 1
                else:
                    number, first, size = number + 1, row, 1
                last = row
                found.append(number)
            yield pdf.assign(**{out: found})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def span_groups(df: DataFrame, keys: list[str], order: list[str], least: float, gap: float) -> DataFrame:
    """Rows join while their group is shorter than ``least`` and the gap is at most ``gap``."""
    return fold(df, keys, order, lambda first, last, n, row: last.end - first.start < least and row.start - last.end <= gap)


def limit_batches(df: DataFrame, keys: list[str], order: list[str], most_rows: int, most_span: float, most_gap: float) -> DataFrame:
    """A batch is closed when it is full, when its span would grow too long, or at a gap."""
    return fold(df, keys, order, lambda first, last, n, row: n < most_rows and row.end - first.start <= most_span and row.start - last.end <= most_gap, "batch")


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str = "row_id", form: str = "seg_%04d") -> DataFrame:
    return df.withColumn(out, F.format_string(form, F.row_number().over(W.partitionBy(*keys).orderBy(*order))))


def absorb_short(df: DataFrame, keys: list[str], least: float, most_gap: float, most_span: float, text: str | None = None) -> DataFrame:
    """Intervals (start, end) shorter than ``least`` join the nearer neighbour (of equal ones the left) if gap and joined span allow, again and again.

    Returns keys, start, end and n (rows joined), and ``text`` put together if it is named. Mutates step by step, so one key is one task.
    """
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end"], kind="stable")
        texts = pdf[text].tolist() if text else [""] * len(pdf)
        rows = [[s, e, 1, t] for s, e, t in zip(pdf["start"], pdf["end"], texts)]
        i = 0
        while i < len(rows):
            s, e = rows[i][:2]
            if e - s < least:
                left = s - rows[i - 1][1] if i and e - rows[i - 1][0] <= most_span else float("inf")
                right = rows[i + 1][0] - e if i + 1 < len(rows) and rows[i + 1][1] - s <= most_span else float("inf")
                if min(left, right) <= most_gap:
                    j = i - 1 if left <= right else i
                    a, b = rows[j], rows[j + 1]
                    rows[j : j + 2] = [[a[0], max(a[1], b[1]), a[2] + b[2], a[3] + b[3]]]
                    i = j
                    continue
            i += 1
        out = pd.DataFrame(rows, columns=["start", "end", "n", text or "_t"])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "start", "end", "n", *([text] if text else [])]]

    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.groupBy(*keys).applyInPandas(run, f"{head}, start {kind('start')}, end {kind('end')}, n bigint" + (f", `{text}` string" if text else ""))


def pick_apart(df: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    """At most ``k`` intervals (start, end) of each key, best score first (of equal ones the smaller id), none overlapping one picked before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in pdf.sort_values([score, ident], ascending=[False, True], kind="stable").itertuples():
            if len(kept) < k and all(r.end <= o.start or r.start >= o.end for o in kept):
                kept.append(r)
        return pdf.loc[[r.Index for r in kept]]

    return df.groupBy(*keys).applyInPandas(run, df.schema)
