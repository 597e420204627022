"""Choosing a subset of clips: balanced over buckets, near a target pace, or a group as a whole. Rows are dicts with id, seconds, pace, quality, score, bucket.

One speaker is one task: the searches are sequential by nature, and a speaker's candidates are of bounded number.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def rank(r: dict) -> tuple:
    return -r["score"], -r["quality"], r["seconds"], r["id"]


def balanced(rows: list[dict], shares: dict[str, float], target: float) -> list[dict]:
    """Rows until the target is reached, each time from the bucket that is furthest below its share of what has been picked; all if they do not exceed it."""
    rest = sorted(rows, key=rank)
    if sum(r["seconds"] for r in rest) <= target:
        return rest
    picked: list[dict] = []
    total, by = 0.0, dict.fromkeys(shares, 0.0)
    while rest and total < target:
        lack = lambda r: shares.get(r["bucket"], 0.0) - (by.get(r["bucket"], 0.0) / total if total else 0.0)
        best = min(rest, key=lambda r: (-lack(r), *rank(r)))
        rest.remove(best)
        picked.append(best)
        total += best["seconds"]
        by[best["bucket"]] = by.get(best["bucket"], 0.0) + best["seconds"]
    return picked


@dataclass(frozen=True)
class Choice:
    """A set of rows with its running sums."""

    rows: tuple = ()
    seconds: float = 0.0
    pace: float = 0.0  # weighted by seconds, as the next two
    square: float = 0.0
    score: float = 0.0

    def plus(self, r: dict) -> Choice:
        s, p = r["seconds"], r["pace"]
        return Choice((*self.rows, r), self.seconds + s, self.pace + p * s, self.square + p * p * s, self.score + r["score"] * s)

    @property
    def mean(self) -> float:
        return self.pace / self.seconds if self.seconds else 0.0

    @property
    def spread(self) -> float:
        return max(0.0, self.square / self.seconds - self.mean**2) if self.seconds else 0.0

    @property
    def average(self) -> float:
        return self.score / self.seconds if self.seconds else 0.0

    def promise(self, pace: float, target: float) -> tuple:
        off = abs(self.mean - pace) if self.seconds else 0.0
        return min(self.seconds / max(target, 1e-6), 1.0), self.spread, self.average, -off, -len(self.rows)

    def merit(self, pace: float, target: float) -> tuple:
        return self.spread + 0.25 * self.average, self.spread, self.average, -abs(self.mean - pace), -abs(self.seconds - target)

    def good(self, pace: float, target: float, tolerance: float) -> bool:
        return self.seconds + 1e-6 >= target and abs(self.mean - pace) <= tolerance + 1e-9


def pruned(choices: list[Choice], beam: int, pace: float, target: float) -> list[Choice]:
    """The most promising choice of each bin of length, pace and number, and of these the best ``beam``."""
    best: dict[tuple, Choice] = {}
    for c in choices:
        key = round(c.seconds * 2), round((c.mean - pace) * 10), len(c.rows)
        if key not in best or c.promise(pace, target) > best[key].promise(pace, target):
            best[key] = c
    return sorted(best.values(), key=lambda c: c.promise(pace, target), reverse=True)[:beam]


def beam_search(rows: list[dict], pace: float, target: float, most: float, tolerance: float, beam: int = 768, iterations: int = 12_000) -> list[dict]:
    """Rows whose seconds reach the target within ``most`` and whose mean pace is within the tolerance, with the best merit that the beam meets; a local search if it meets none."""
    rows = sorted((r for r in rows if r["pace"]), key=lambda r: (-abs(r["pace"] - pace), *rank(r)))
    choices, best = [Choice()], None
    for r in rows:
        more = [c.plus(r) for c in choices if c.seconds + r["seconds"] <= most + 1e-6]
        choices = pruned([*choices, *more], beam, pace, target)
        for c in choices:
            if c.good(pace, target, tolerance) and (best is None or c.merit(pace, target) > best.merit(pace, target)):
                best = c
    if best is not None:
        return list(best.rows)
    return local_search(rows, pace, target, most, tolerance, iterations)


def local_search(rows: list[dict], pace: float, target: float, most: float, tolerance: float, iterations: int) -> list[dict]:
    """Seeded by the rows' ids: rows are swapped in and out at random; a change stays if it is better, or now and then anyway. The best choice met, or none."""
    if not rows or iterations <= 0:
        return []
    draw = random.Random(hashlib.sha256("|".join([*sorted(str(r["id"]) for r in rows), f"{pace:.6f}", f"{target:.6f}"]).encode()).hexdigest())
    at = {r["id"]: r for r in rows}

    def fit(ids: set) -> set:
        """Rows out until it is short enough, then in while it is too short."""
        out = set(ids)
        while out and sum(at[i]["seconds"] for i in out) > most:
            out.discard(draw.choice(sorted(out)))
        for i in draw.sample(sorted(at), len(at)):
            total = sum(at[k]["seconds"] for k in out)
            if total >= target:
                break
            if i not in out and total + at[i]["seconds"] <= most:
                out.add(i)
        return out

    def measured(ids: set) -> Choice:
        c = Choice()
        for i in sorted(ids):
            c = c.plus(at[i])
        return c

    now, best = fit(set()), None
    for _ in range(iterations):
        trial = set(now)
        trial.symmetric_difference_update(draw.sample(sorted(at), min(len(at), draw.randint(1, 2))))
        trial = fit(trial)
        c = measured(trial)
        ok = c.good(pace, target, tolerance)
        if ok and (best is None or c.merit(pace, target) > best.merit(pace, target)):
            best = c
        old = measured(now)
        if (ok and (not old.good(pace, target, tolerance) or c.merit(pace, target) > old.merit(pace, target))) or draw.random() < 0.02:
            now = trial
    return list(best.rows) if best else []


def tolerances(first: float, last: float) -> list[float]:
    """Doubled from the first to the last."""
    out = [first]
    while out[-1] + 1e-9 < last:
        out.append(min(last, out[-1] * 2 if out[-1] else 0.05))
    return out


def paced(rows: list[dict], pace: float | None, target: float, shares: dict[str, float], beam: int = 768, iterations: int = 12_000) -> list[dict]:
    """By pace, with growing tolerance, then with more overhang; balanced by bucket if there is no pace or no way."""
    viable = [r for r in rows if r["pace"]]
    if pace and viable:
        for most in (target + max(1.0, 0.1 * target), target + max(r["seconds"] for r in viable)):
            for tolerance in tolerances(0.10, 0.30):
                found = beam_search(viable, pace, target, most, tolerance, beam, iterations)
                if found:
                    return found
    return balanced(rows, shares, target)


def select(df: DataFrame, by: list[str], choose) -> DataFrame:
    """``choose`` (list of rows to list of rows) for each speaker; its order is kept in ``place``. A row that is chosen twice comes once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", place int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = {r["id"]: r for r in choose(pdf.sort_values("id").to_dict("records"))}
        out = pd.DataFrame(list(chosen.values()), columns=pdf.columns)
        return out.assign(place=range(len(out)))

    return df.groupBy(*by).applyInPandas(run, schema)


def score_filter(df: DataFrame, score: str, least: float | None) -> DataFrame:
    """Adds ``reason``: a score below the minimum; nothing without a minimum."""
    if least is None:
        return df.withColumn("reason", F.lit(None).cast("string"))
    return df.withColumn("reason", F.when(F.col(score) < least, F.concat(F.lit("training_selection_score_below_min:"), F.format_string("%.3f", score), F.lit(f"<{least:.3f}"))))


def best_group(df: DataFrame, by: list[str], group: str, score: Column, seconds: str, reference: Column, n_reference: Column) -> DataFrame:
    """The group with the best score (then more rows, longer, the greater name), if it has as many rows as the reference or lasts 75 to 125 % of it."""
    sums = df.groupBy(*by, group).agg(F.max(score).alias("_s"), F.count("*").alias("n"), F.sum(seconds).alias("seconds"), F.first(reference).alias("_r"), F.first(n_reference).alias("_n"))
    top = sums.groupBy(*by).agg(F.max(F.struct("_s", "n", "seconds", group, "_r", "_n")).alias("t"))
    ratio = F.try_divide(F.col("t.seconds"), F.col("t._r"))
    fits = (F.col("t.n") == F.col("t._n")) | F.coalesce(F.col("t._r") == 0, F.lit(True)) | ratio.between(0.75, 1.25)
    return top.where(fits).select(*by, f"t.{group}", "t.n", "t.seconds")


#: Endings of file names that tell variants of one recording.
VARIANTS = "(?:[ _.-]*(?:no[ _-]?se|no[ _-]?bgm|se[ _-]?nashi|dry|mix|master|wav|mp3|flac|効果音なし|seなし|bgmなし))$"


def variant_key(path: Column) -> Column:
    """A path's folder and name without extension, in one Unicode form, with endings that tell variants taken off until none is left."""
    from timeloom.functions.kernel import nfkc

    name = F.lower(F.regexp_replace(nfkc(path), "\\.[^./]*$", ""))
    for _ in range(4):
        name = F.regexp_replace(F.regexp_replace(name, VARIANTS, ""), "[ _.-]+$", "")
    return name


def appended(candidates: str, ident: Column, text: Column) -> Column:
    """An array of struct<id, text> with one more, unless its text is empty or there already."""
    c, t = F.col(candidates), F.trim(text)
    return F.when((t == "") | F.exists(c, lambda x: F.trim(x["text"]) == t), c).otherwise(F.concat(c, F.array(F.struct(ident.alias("id"), t.alias("text")))))


def merged_history(old: DataFrame, new: DataFrame, by: list[str], header: list[str], history: str) -> DataFrame:
    """Histories one after the other, with the new header; a key that only one side has is kept."""
    o = old.select(*by, *[F.col(h).alias(f"_o_{h}") for h in header], F.col(history).alias("_oh"))
    met = o.join(new, by, "full")
    rows = lambda c: F.coalesce(F.col(c), F.array().cast(met.schema["_oh"].dataType))
    return met.select(*by, *[F.coalesce(h, f"_o_{h}").alias(h) for h in header], F.concat(rows("_oh"), rows(history)).alias(history))


def distinct_by(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The first row of each key, in order."""
    rows = df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), order).alias("_r"))
    return rows.select("_r.*")
