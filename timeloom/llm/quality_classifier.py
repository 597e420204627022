"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

Every whole text gives a row of statistics (``STATS``). They are scaled, mapped to ``features`` random Fourier features that
approximate a Gaussian kernel, and fitted by ridge regression: partitions sum their parts of the normal equations, which are added up
by entry (features squared numbers, at any corpus size). Scores on labelled documents that the fit has not seen are counted in
``BINS`` bins, and pooling adjacent violators over the bins gives the calibrated probability.

All labelled rows of the training folds are used: fold 1 calibrates, the others but the held-out fold 0 fit.

Defined cases. A null or empty text has zero statistics and gets a score like any other. Labels without a document, and null labels, are
passed over; a document labelled more than once counts for each label. Without any label every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.common import fold, stage, table

STATS = ("log_words", "log_chars", "word_length", "symbols", "exclaims", "pipes", "capitals", "digits", "stops", "commas", "variety", "same_next", "dup_lines", "log_line_words", "beyond_ascii", "long_words")
FEATURES = 192
RIDGE = 1e-3
WIDTH = 2.0
BINS = 1000
THRESHOLD = 0.3
CAPITALS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
SMALL = CAPITALS.lower()


def statistics(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    gone = lambda drop: len(b) - len(b.translate(None, drop))
    chars = sum(map(len, words))
    capitals, small = gone(CAPITALS), gone(SMALL)
    lines = [x for x in b.split(b"\n") if x.strip()]
    return [
        np.log1p(n),
        np.log1p(chars),
        chars / n,
        gone(b"#*$%&|<>") / n,
        b.count(b"!") / n,
        b.count(b"|") / n,
        capitals / max(1, capitals + small),
        gone(DIGITS) / chars,
        b.count(b".") / n,
        b.count(b",") / n,
        len(set(words)) / n**0.8,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        sum(map(len, (b.translate(None, bytes(range(128))),))) / chars,
        sum(len(w) > 20 for w in set(words)) / n,
    ]


def statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "stats": pa.array(rows, pa.list_(pa.float64()))})


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.scale = (2 / features) ** 0.5
        self.beta = np.zeros(features + 1)
        self.edges, self.values = np.array([0.5]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([self.scale * np.cos(x @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Ridge scores on the grid of bins, which spans -0.5 to 1.5."""
        return np.clip(np.round((self.features(stats) @ self.beta + 0.5) / 2 * BINS), 0, BINS)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.values)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: x ascending, y sums, n counts; the fitted value at each x."""
    blocks: list[list[float]] = []
    for total, count in zip(y, n):
        blocks.append([total, count, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, count, width = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + count, blocks[-1][2] + width]
    return x, np.concatenate([np.full(int(w), t / c) for t, c, w in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """stats: doc_id, stats. labels: doc_id, y (0 or 1), calibrate (boolean). None without labels."""
    spark = stats.sparkSession
    rows = stage(stats.join(labels.where(F.col("y").isNotNull()), "doc_id").select("stats", F.col("y").cast("double").alias("y"), "calibrate"), "quality-labelled")
    d = len(STATS)
    at = lambda i: F.get("stats", F.lit(i))
    head = rows.agg(F.count("y").alias("n"), *[F.avg(at(i)).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(at(i)).alias(f"s{i}") for i in range(d)]).first()
    if not head["n"]:
        return None
    mean, spread = (np.array([head[f"{k}{i}"] for i in range(d)]) for k in "ms")
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))
    shared = spark.sparkContext.broadcast(model)
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z, y = shared.value.features(matrix(batch.column(0), d)), np.asarray(batch.column(1))
            a += z.T @ z
            c += z.T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.r_[upper[0], np.arange(size)].astype(np.int32)), "j": pa.array(np.r_[upper[1], np.full(size, -1)].astype(np.int32)), "v": pa.array(np.r_[a[upper], c])})

    some = rows.where(~F.col("calibrate"))
    sums = some.select("stats", "y").mapInArrow(equations, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (np.asarray(sums.column(k)) for k in ("i", "j", "v"))
    a, c = np.zeros((size, size)), np.zeros(size)
    c[i[j < 0]] = v[j < 0]
    a[i[j >= 0], j[j >= 0]] = v[j >= 0]
    a = a + np.triu(a, 1).T
    model.beta = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.eye(size), c)
    shared = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bin": pa.array(shared.value.raw(matrix(batch.column(0), d)).astype(np.int32)), "y": batch.column(1)})

    bins = rows.where("calibrate").select("stats", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("y").alias("n")).orderBy("bin").toArrow()
    if bins.num_rows:
        model.edges, model.values = isotonic(*(np.asarray(bins.column(k), np.float64) for k in ("bin", "y", "n")))
    else:  # too few labels to calibrate: the ridge scores as they are
        model.edges, model.values = np.array([BINS * 0.25, BINS * 0.75]), np.array([0.0, 1.0])
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text. labels: doc_id, y, calibrate. Returns doc_id, score."""
    spark = docs.sparkSession
    stats = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(statistics_rows, "doc_id long, stats array<double>"), "quality-stats")
    model = fit(stats, labels)
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(shared.value.score(matrix(batch.column(1), len(STATS))))})

    return stats.mapInArrow(scored, "doc_id long, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    at = fold(F.col("doc_id"), 5)
    known = labels.where(at != 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y"), (at == 1).alias("calibrate"))
    scored = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), known)
    return scored.select("doc_id", (at == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
