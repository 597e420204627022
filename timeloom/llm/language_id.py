"""Language identification with bit-sliced Bloom filters over letter n-grams.

Per language, byte 4-grams of the lower-cased letters are counted over all training texts; those with at least ``least`` of their
language's total are its members (at most 1/least a language, whatever the corpus holds, so the filter may be broadcast). One
filter holds all languages: each position is a bitmask of languages, and the masks at an n-gram's positions and-ed together
name all languages that hold it. A text's hits are counted per language (popcounts by bit), corrected for the filter's known rate of
false positives, and the most hits decide.

Defined cases. Text that is null or has no letter: ``und``, score 0. Letters but no hit in any language: the language with most training
documents, score 0. Ties go to the smaller name. Rows without a language are not learned from. With nothing to learn from every text
is ``und``. Texts are read whole, in pieces that overlap. Other columns are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.llm.common import fold, table

LEAST = 2.0**-15
BITS_PER_GRAM = 16
HASHES = 3
PIECE = 4 << 20
#: Bytes that are not letters become spaces; those from 0x80 on belong to letters.
LETTERS = bytes(b if chr(b).isalpha() or b >= 0x80 else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def grams(text: bytes) -> np.ndarray:
    """The 4-grams of bytes, as 32-bit numbers; those of spaces alone are left out."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.empty(0, np.uint32)
    g = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    return g[g != 0x20202020]


def letters(text: str) -> bytes:
    return b"  " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b"  "


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n); gram -1 counts documents."""
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            texts.setdefault(lang, []).append(letters(text.as_py() or ""))
            sizes[lang] = sizes.get(lang, 0) + 1
        for lang, found in texts.items():
            whole = b"".join(found)
            keys, counts = [np.array([-1])], [np.array([sizes[lang]])]
            for at in range(0, len(whole), PIECE):
                k, n = np.unique(grams(whole[at : at + PIECE + 3]), return_counts=True)
                keys.append(k.astype(np.int64))
                counts.append(n)
            n = sum(map(len, keys))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * n), "gram": pa.array(np.concatenate(keys)), "n": pa.array(np.concatenate(counts).astype(np.int64))})


class Filter:
    """Languages by bit; ``masks`` holds a row of 64 languages for each 64 of them."""

    def __init__(self, members: dict[str, np.ndarray], documents: dict[str, int], bits_per_gram: int = BITS_PER_GRAM):
        self.langs = sorted(members)
        self.prior = max(self.langs, key=lambda x: (documents.get(x, 0), [-ord(c) for c in x]), default="und")
        most = max([len(g) for g in members.values()], default=0)
        self.shift = 32 - max(10, int(most * bits_per_gram - 1).bit_length())
        self.masks = np.zeros((-(-len(self.langs) // 64), 1 << (32 - self.shift)), np.uint64)
        wrong = []
        for i, lang in enumerate(self.langs):
            row, bit = self.masks[i // 64], np.uint64(1 << (i % 64))
            for at in self.spots(members[lang]):
                row[at] |= bit
            wrong.append((((row & bit) != 0).mean()) ** HASHES)
        self.wrong = np.array(wrong)
        if len(self.langs) <= 8:  # small masks stay in the processor's cache
            self.masks = self.masks.astype(np.uint8)

    def spots(self, g: np.ndarray) -> list[np.ndarray]:
        g = g.astype(np.uint32)
        g = g ^ (g >> np.uint32(15))
        return [((g * np.uint32(m)) >> np.uint32(self.shift)) for m in MIX]

    def hits(self, text: bytes) -> np.ndarray:
        """Per language, the n-grams of the text that it holds, corrected for false positives."""
        count, total = np.zeros(len(self.langs)), 0
        for at in range(0, max(1, len(text) - 3), PIECE):
            g = grams(text[at : at + PIECE + 3])
            spots = self.spots(g)
            total += len(g)
            for r, row in enumerate(self.masks):
                found = row[spots[0]] & row[spots[1]] & row[spots[2]]
                here = min(64, len(self.langs) - 64 * r)
                if here <= 8:
                    n = np.bincount(found, minlength=256)
                    count[64 * r : 64 * r + here] += [n[(np.arange(256) >> b) & 1 == 1].sum() for b in range(here)]
                else:
                    count[64 * r : 64 * r + here] += [int(((found >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(here)]
        return np.maximum(0.0, (count - total * self.wrong) / (1 - np.minimum(self.wrong, 0.999)))

    def judge(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not LETTER.search(text):
            return "und", 0.0
        hits = self.hits(letters(text))
        best = int(hits.argmax())
        if hits[best] <= 0:
            return self.prior, 0.0
        return self.langs[best], float(hits[best] / hits.sum())


def learn(docs: DataFrame, least: float = LEAST) -> Filter:
    """docs: lang, text; rows without a language are passed over."""
    counts = docs.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.where("gram >= 0").groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(total, "lang", "left").where((F.col("gram") < 0) | (F.col("n") >= least * F.col("total"))).select("lang", "gram", "n").toArrow()
    members: dict[str, list[int]] = {}
    documents: dict[str, int] = {}
    for lang, gram, n in zip(*(kept.column(k).to_pylist() for k in range(3))):
        if gram < 0:
            documents[lang] = n
        else:
            members.setdefault(lang, []).append(gram)
    return Filter({k: np.array(members.get(k, []), np.int64) for k in documents}, documents)


def identify(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to ``docs``; columns of these names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            got = [f.judge(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 5) == 0


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
