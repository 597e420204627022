"""Benchmark decontamination: n-gram seeds find candidates, Smith-Waterman alignment scores them.

Words are lower-cased (A-Z), without ASCII punctuation. Every word trigram of an item is a seed, whether or how often it occurs in the documents.
A document that holds a seed is aligned with the item around its seeds, as far as an alignment of the least score can reach: word against
word, match 2, mismatch -1, gap -1, best local score. Windows that cannot reach it, because too few of the item's words stand in them, are not
aligned. The score is divided by that of a perfect copy; pairs with at least ``LEAST_SCORE`` are leaks. Edited and partly copied items keep
most of the score. So every pair of that score is found that has three successive words in common.

An item of one or two words is found where it stands as a whole.

Items are taken in blocks of at most ``BLOCK_WORDS`` words, each of which is broadcast and meets all documents in turn; documents are read
where they are and nothing of their text is shuffled.

Defined cases. Null or empty texts leak nothing. An item without words leaks nowhere. Repeated items and repeated rows
are reported as often as they stand. Of several alignments of a document with one item the best is returned, and of equal ones the first. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.common import fresh, row_hash, table

LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 200_000
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
AT_ONCE, AT_ONCE_BYTES = 400, 8 << 20  # texts that are read into one array


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(None, PUNCTUATION).split()


def best_local(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local alignment score of two sequences of numbers (0 matches nothing), and where it ends in ``text``."""
    ramp = -GAP * np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item.tolist():
        here = np.maximum(above + GAP, 0)
        here[1:] = np.maximum(here[1:], above[:-1] + np.where((text == w) & (w != 0), MATCH, MISMATCH))
        here = np.maximum.accumulate(here + ramp) - ramp  # gaps in the item, any length
        at = int(here.argmax())
        if here[at] > best:
            best, end = int(here[at]), at
        above = here
    return best, end


class Items:
    """A block of items: their words numbered from 1, and their trigrams as sorted keys with the items and places that hold them."""

    def __init__(self, rows: list[tuple[int, list[bytes]]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.words = [np.array([number(w) for w in ws], np.int64) for _, ws in rows]
        self.base = len(self.vocabulary) + 1
        found = [(int(k), at, place) for at, ws in enumerate(self.words) for place, k in enumerate(self.keys(ws))]
        found.sort()
        key = np.array([x[0] for x in found], np.int64)
        self.seeds, first = np.unique(key, return_index=True)
        ends = [*first[1:].tolist(), len(found)]
        self.places = [[x[1:] for x in found[lo:hi]] for lo, hi in zip(first.tolist(), ends)]  # (item, place) of each seed
        self.short: dict[int, dict[int, list[int]]] = {1: {}, 2: {}}  # items of one and two words by their key
        for at, ws in enumerate(self.words):
            if len(ws) in self.short:
                self.short[len(ws)].setdefault(int(self.pair(ws)[0]), []).append(at)

    def keys(self, a: np.ndarray) -> np.ndarray:
        """The trigram that starts at each position; 0 where a word is not of the items."""
        if len(a) < 3:
            return np.empty(0, np.int64)
        k = (a[:-2] * self.base + a[1:-1]) * self.base + a[2:]
        k[(a[:-2] == 0) | (a[1:-1] == 0) | (a[2:] == 0)] = 0
        return k

    def pair(self, a: np.ndarray) -> np.ndarray:
        """A key for one or two words that stand side by side."""
        return a if len(a) == 1 else a[:-1] * self.base + a[1:]

    def whole(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where an item of one or two words ends, and the item."""
        for n, items in self.short.items():
            if items and len(ids) >= n:
                k = ids if n == 1 else np.where((ids[:-1] != 0) & (ids[1:] != 0), ids[:-1] * self.base + ids[1:], 0)
                for p in np.flatnonzero(np.isin(k, np.fromiter(items, np.int64, len(items)))).tolist():
                    for item in items[int(k[p])]:
                        yield p + n - 1, item

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of some texts, one after the other with two zeros between, and where each text starts."""
        ids: list[int] = []
        starts = []
        for t in texts:
            starts.append(len(ids))
            ids.extend(map(self.vocabulary.get, words_of(t), repeat(0)))
            ids += (0, 0)
        return np.array(ids, np.int64), np.array(starts, np.int64)

    def meet(self, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose trigram is in the sorted ``known``, and its number there."""
        if not len(known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = self.keys(ids)
        at = np.flatnonzero(k)
        where = np.minimum(np.searchsorted(known, k[at]), len(known) - 1)
        hit = known[where] == k[at]
        return at[hit], where[hit]


def pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts that are read at once, bounded by number and size; a longer text is alone."""
    lo = total = 0
    for k, n in enumerate(sizes):
        if k > lo and (k - lo == AT_ONCE or total + n > AT_ONCE_BYTES):
            yield lo, k
            lo, total = k, 0
        total += n
    if sizes:
        yield lo, len(sizes)


def alignments(shared, least: float):
    """(doc_id, text) to the pairs that leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        names = ("doc_id", "item_id", "score", "last_word")
        for batch in batches:
            out: list[tuple] = []
            sizes = [0 if t is None else len(t) for t in batch.column(1).to_pylist()]
            for lo, hi in pieces(sizes):
                docs = batch.column(0).slice(lo, hi - lo)
                ids, starts = items.read(batch.column(1).slice(lo, hi - lo).to_pylist())
                seen: set[tuple[int, int]] = set()
                for end, item in items.whole(ids):
                    d = int(np.searchsorted(starts, end, "right")) - 1
                    if (d, item) not in seen:
                        seen.add((d, item))
                        out.append((docs[d].as_py(), items.ids[item], 1.0, end - int(starts[d])))
                at, which = items.meet(ids, items.seeds)
                if not len(at):
                    continue
                ends = np.r_[starts[1:], len(ids)] - 2
                tries: dict[tuple[int, int], list[int]] = {}
                doc = np.searchsorted(starts, at, "right") - 1
                for a, w, d in zip(at.tolist(), which.tolist(), doc.tolist()):
                    for item, place in items.places[w]:
                        tries.setdefault((d, item), []).append(a - place)
                for (d, item), begins in tries.items():
                    own = items.words[item]
                    n = len(own)
                    reach = max(0, int((1 - least) * MATCH * n))  # gaps cost 1 each, so an alignment of the least score has no more
                    first, end = int(starts[d]), int(ends[d])
                    windows: list[list[int]] = []
                    for b in sorted(set(begins)):  # where the item would begin
                        lo_w, hi_w = max(first, b - reach), min(end, b + n + reach)
                        if windows and lo_w <= windows[-1][1]:
                            windows[-1][1] = hi_w
                        else:
                            windows.append([lo_w, hi_w])
                    best, last = 0, 0
                    for lo_w, hi_w in windows:
                        if MATCH * int(np.isin(own, ids[lo_w:hi_w]).sum()) < least * MATCH * n:
                            continue
                        got, at_end = best_local(own, ids[lo_w:hi_w])
                        if got > best:
                            best, last = got, lo_w + at_end - 1 - first
                    if best >= least * MATCH * n:
                        out.append((docs[d].as_py(), items.ids[item], best / (MATCH * n), last))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=list(names))

    return run


def blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of at most BLOCK_WORDS words (or one item)."""
    rows, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        words = words_of(r[1])
        if rows and size + len(words) > BLOCK_WORDS:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r[0], words))
        size += len(words)
    if rows:
        yield Items(rows)


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs: doc_id, text. items: item_id, text. Returns doc_id, item_id, score, last_word (where the best alignment ends)."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, last_word long"
    found = []
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)
        found.append(d.mapInArrow(alignments(shared, least), schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text leaks no item, whatever other rows have their doc_id."""
    (row,) = fresh(docs, "row")
    bad = leaks(docs.select(row_hash().alias("doc_id"), "text"), items, least).select(F.col("doc_id").alias(row)).distinct()
    return docs.withColumn(row, row_hash()).join(bad, row, "left_anti").drop(row)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
