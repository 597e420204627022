"""Language-model scoring with a weighted backoff automaton.

Counts come from all training documents. Every word and every sequence of up to ``order`` words that occurs in them (``least`` times or more, 1 as it
comes) is an arc, and what it leads to is a state of the automaton. Probabilities are discounted absolutely and interpolated: an arc's is
(count - D) / count of its state + weight of the state's failure arc x probability of the word in the state that this leads to (the longest
proper suffix). The failure arc's weight is what discounting has left, so that each state's distribution sums to 1 over known words and one unknown. The root's arcs
are all words of the corpus, add-one smoothed. A text is read from left to right once: each word is followed from the longest state, by failure
arcs where there is no arc, and the logarithms are added up.

The automaton grows with the corpus, so no machine holds all of it. Documents are dealt over blocks where they are read, and a block gets the arcs and weights
that its own documents meet. States and words are numbered densely, length after length. In a round for each length, a block sends each of
its distinct sequences once, with its count, to the part of the table that the number of the sequence's state names; the part adds up the counts of all
blocks, numbers the sequences, and returns counts, numbers and, for each state, the sum and number of its arcs, from which the weight of the failure arc follows. States
with more than their share of arcs are split over several parts by the word, and the block adds up what each of these returns. So no key is hot, a key
occurs once in a block's message at most, nothing is broadcast, and blocks and parts are bounded in size while their number grows with the input.

Words are told apart by 64 bits of their hash, longer sequences by the numbers of their state and last word. Defined cases: a null text counts as empty
and has the end token only. With no training documents every probability is 1/(0+1). Repeated rows count as often as they stand. Other columns are ignored.
Order of summation within a document is fixed; documents do not influence each other's scores except through counts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.common import fold, free_shuffles, input_bytes, stage, table, unstage

END = b"\n"  # no word can hold it
ORDER = 3
LEAST = 1
DISCOUNT = 0.5
BLOCK_BYTES = 4 << 20
PART_BYTES = 6 << 20
SPLIT = 4  # a state with more than 1/SPLIT of the tokens of a part is split
ROWS = "block long, kind int, pid int, data binary"
STATE = 0  # kind of the rows that hold a block's documents; other kinds are lengths of sequences
WORD_BITS = 36  # numbers of words are below 2^36
DTYPES = ("u1", "u2", "u4", "u8", "i8", "f8")


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased. bytes.split() separates at exactly space and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "replace").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each in as few bytes as hold its values, their bytes in planes and compressed."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        if a.dtype.kind in "ui" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        elif a.dtype.kind == "b" or not len(a):
            a = a.astype(np.uint8)
        out.append(struct.pack("<Bq", DTYPES.index(a.dtype.str[1:]), len(a)))
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    raw = b"".join(out)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], struct.unpack_from("<q", data)[0], codec="zstd", asbytes=True)
    out, at = [], 1
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<Bq", raw, at)
        at, size = at + 9, int(DTYPES[kind][1])
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(DTYPES[kind]).reshape(n))
        at += n * size
    return out


def signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64)


def rows_of(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    block, kind, pid, data = zip(*rows) if rows else ((),) * 4
    return pa.table({"block": pa.array(block, pa.int64()), "kind": pa.array(kind, pa.int32()), "pid": pa.array(pid, pa.int32()), "data": pa.array(data, pa.binary())})


def slices(pid: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    cuts = np.flatnonzero(np.r_[True, np.diff(pid) != 0]) if len(pid) else np.empty(0, np.int64)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pid)]):
        yield int(pid[lo]), slice(lo, hi)


def read_blocks(limit: int, parts: int):
    """(doc_id, held_out, text) to a row of kind STATE for every ``limit`` bytes of text, numbered by task, and its words with their counts (kind 1) by part.

    Words are numbered in the order in which they are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        local: dict[bytes, int] = {END: 0}
        docs: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, len(local))
            pid = (words >> np.uint64(32)) % np.uint64(parts)
            by = np.lexsort((words, pid))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            lengths = np.array([len(x) + 2 for *_, x in docs], np.int64)  # a text starts as if an end came before
            starts = np.cumsum(lengths) - lengths
            stream = np.zeros(lengths.sum(), np.int64)
            for at, (*_, x) in zip(starts.tolist(), docs):
                stream[at + 1 : at + 1 + len(x)] = x
            stream = rank[stream]
            held = np.array([h for _, h, _ in docs], bool)
            inner = np.ones(len(stream), bool)
            inner[starts] = False
            n = np.bincount(stream, np.repeat(~held, lengths) & inner, len(by)).astype(np.int64)
            sent = [(block, 1, p, pack(words[by[here]], n[here])) for p, here in slices(pid[by].astype(np.int64))]
            ids = np.array([d or 0 for d, *_ in docs], np.int64)
            state = pack(stream, lengths, held, ids, np.array([d is None for d, *_ in docs], bool), np.bincount(pid.astype(np.int64), minlength=parts))
            return rows_of([(block, STATE, 0, state), *sent]).combine_chunks().to_batches()[0]

        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = tokens(text.as_py())
                docs.append((doc_id, held, np.fromiter((local.setdefault(w, len(local)) for w in words), np.int32, len(words))))
                size += sum(map(len, words)) + len(words)
                if size >= limit:
                    yield done()
                    local, docs, size, block = {END: 0}, [], 0, block + 1
        if docs:
            yield done()

    return run


class Level:
    """The sequences of one length in a block, in the order in which they are sent: ``at``, the one that ends at each token, or -1; their state (its place
    in the level below), the number of their last word, and their count and own number over all blocks."""

    def __init__(self, at: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray):
        self.at, self.context, self.word, self.n = at, context, word, n
        self.count, self.gid = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)

    def keep(self, least: int) -> None:
        """Only what occurs often enough stays."""
        some = self.count >= least
        if some.all():
            return
        number = np.append(np.where(some, np.cumsum(some) - 1, -1), -1)
        self.at = number[self.at]
        for name in ("context", "word", "count", "gid"):
            setattr(self, name, getattr(self, name)[some])


class Block:
    """What a block knows when sequences of up to ``counted`` words have been counted over all blocks."""

    def __init__(self, rows: pa.Table, parts: int, counted: int, total: int, kinds: int, least: int):
        self.parts, self.total, self.bottom = parts, total, total + kinds + 1
        self.block = rows.column("block")[0].as_py()
        got: dict[int, dict[int, bytes]] = {}
        for kind, pid, data in zip(*(rows.column(k).to_pylist() for k in ("kind", "pid", "data"))):
            got.setdefault(kind, {})[pid] = data
        stream, lengths, held, self.doc_ids, self.null_ids, words = unpack(got[STATE][0])
        stream, lengths, self.held = signed(stream), signed(lengths), held.astype(bool)
        self.starts = np.cumsum(lengths) - lengths
        self.train = np.repeat(~self.held, lengths)
        self.inner = np.ones(len(stream), bool)
        self.inner[self.starts] = False
        ends = np.cumsum(signed(words))
        none = np.empty(int(ends[-1]), np.int64)
        level = Level(stream, none, none, none)
        for pid in np.flatnonzero(words).tolist():
            level.count[ends[pid] - words[pid] : ends[pid]], level.gid[ends[pid] - words[pid] : ends[pid]] = unpack(got[1][pid])
        level.word = level.gid
        self.words_at = level.count[stream]
        level.keep(least)
        self.levels = [level]
        self.left: list[np.ndarray] = []  # weight of the failure arc of each state, by length of the states
        for k in range(2, counted + 1):
            level, states = self.next(), len(self.levels[-1].count)
            kept, arcs = np.zeros(states), np.zeros(states)
            for pid, here in slices(self.group_pid):
                count, gid, s, m = unpack(got[k][pid])
                mine = slice(self.group_start[here.start], self.group_start[here.stop])
                level.count[mine], level.gid[mine] = count, np.cumsum(signed(gid)) * parts + pid
                np.add.at(kept, self.group_context[here], s)
                np.add.at(arcs, self.group_context[here], m)
            c = self.levels[-1].count
            kept = np.where(arcs > 0, c, 0) if least == 1 else kept  # every arc of a state is kept, so they make up its count
            self.left.append((c - kept + DISCOUNT * arcs) / np.maximum(c, 1))
            level.keep(least)
            self.levels.append(level)

    def next(self) -> Level:
        """Sequences one word longer, of a known state and a known word, in the order in which they are sent; and the groups, by state and split, that they make."""
        below, first = self.levels[-1], self.levels[0]
        before = np.r_[-1, below.at[:-1]]
        before[~self.inner] = -1
        known = before >= 0
        used = np.flatnonzero(np.bincount(before[known], minlength=len(below.count)))
        splits = np.zeros(len(below.count), np.int64)
        splits[used] = 1 + below.count[used] * (self.parts * SPLIT) // max(1, self.total)
        group_context = np.repeat(np.arange(len(splits)), splits)
        first_group = np.cumsum(splits) - splits
        group_sub = np.arange(len(group_context)) - first_group[group_context]
        group_gid = below.gid[group_context]
        group_pid = (mixed(group_gid + (group_sub << 40)) >> np.uint64(20)).astype(np.int64) % self.parts
        by = np.lexsort((group_sub, group_gid, group_pid))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.group_context, self.group_pid, self.group_gid, self.group_sub = group_context[by], group_pid[by], group_gid[by], group_sub[by]
        at = np.flatnonzero(known & (first.at >= 0))
        context, gid = before[at], first.gid[first.at[at]]
        group = first_group[context]
        hot = np.flatnonzero(splits[context] > 1)
        group[hot] += (mixed(gid[hot]) >> np.uint64(8)).astype(np.int64) % splits[context[hot]]
        code, number = np.unique((rank[group] << WORD_BITS) | gid, return_inverse=True)
        positions = np.full(len(before), -1, np.int64)
        positions[at] = number
        group = code >> WORD_BITS
        self.group_start = np.r_[0, np.cumsum(np.bincount(group, minlength=len(by)))]
        return Level(positions, self.group_context[group], code & ((1 << WORD_BITS) - 1), np.bincount(number, self.train[at], len(code)).astype(np.int64))

    def messages(self) -> pa.Table:
        """What the next round is asked."""
        level, out = self.next(), []
        for pid, here in slices(self.group_pid):
            starts = self.group_start[here.start : here.stop + 1]
            mine = slice(starts[0], starts[-1])
            out.append((self.block, len(self.levels) + 1, pid, pack(np.diff(self.group_gid[here], prepend=0), self.group_sub[here], np.diff(starts), level.word[mine], level.n[mine])))
        return rows_of(out)

    def scores(self) -> pa.Table:
        p = root = (self.words_at + 1) / self.bottom
        for level, below, left in zip(self.levels[1:], self.levels, self.left):
            before = np.r_[-1, below.at[:-1]]
            p = np.append(left, 1.0)[before] * p
            known = level.at >= 0
            p[known] += ((level.count - DISCOUNT) / below.count[level.context])[level.at[known]]
        each = lambda x: np.add.reduceat(np.where(self.inner, x, 0), self.starts)
        n = each(np.ones(len(self.inner), np.int64))
        ids = pa.array(signed(self.doc_ids), mask=self.null_ids.astype(bool))
        return pa.table({"doc_id": ids, "held_out": pa.array(self.held), "n_tokens": pa.array(n), "n_known": pa.array(each((self.words_at > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(n), self.total, np.int64)), "base_score": pa.array(each(np.log10(root))), "score": pa.array(each(np.log10(p)))})


def add_words(pid: int, blocks: list[int], data: list[bytes], parts: int) -> Iterator[tuple]:
    """Counts of words over all blocks, and their numbers, small ones for frequent words; the totals go to block -1."""
    asked = [unpack(x) for x in data]
    word, n = (np.concatenate(x) for x in zip(*asked))
    distinct, number = np.unique(word, return_inverse=True)
    c = np.bincount(number, n, len(distinct)).astype(np.int64)
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
    yield -1, 1, pid, pack(np.array([c.sum(), (c > 0).sum()]))
    at = 0
    for block, (w, _) in zip(blocks, asked):
        here = number[at : at + len(w)]
        yield block, 1, pid, pack(c[here], rank[here] * parts + pid)
        at += len(w)


def add_longer(kind: int, pid: int, blocks: list[int], data: list[bytes], least: int, last: bool) -> Iterator[tuple]:
    """Counts of longer sequences over all blocks, their numbers (but for the last length), and the sums (if some arcs are cut) and numbers of the arcs of each state."""
    asked = [unpack(x) for x in data]
    gid = np.concatenate([np.cumsum(x[0].view(np.int64) if x[0].dtype.itemsize == 8 else signed(x[0])) for x in asked])
    sub, size, word, n = (np.concatenate([signed(x[k]) for x in asked]) for k in range(1, 5))
    _, group = np.unique(gid * (int(sub.max()) + 1) + sub, return_inverse=True)
    groups = int(group.max()) + 1
    width = int(word.max(initial=0)) + 1
    word += np.repeat(group, size) * width
    del gid, sub, size  # of the many numbers that a part holds, no more than needed
    code, number = np.unique(word, return_inverse=True)
    c = np.bincount(number, n, len(code)).astype(np.int64)
    del word, n
    kept = c >= least
    index = np.cumsum(kept) - kept
    own = code // width
    del code
    s, m = np.bincount(own, c * kept, groups).astype(np.int64) if least > 1 else np.zeros(groups, np.int64), np.bincount(own, kept, groups).astype(np.int64)
    index = np.zeros_like(index) if last else index
    at = where = 0
    for block, x in zip(blocks, asked):
        g, e = group[at : at + len(x[2])], number[where : where + len(x[3])]
        yield block, kind, pid, pack(c[e], np.diff(index[e], prepend=0), s[g], m[g])
        at, where = at + len(x[2]), where + len(x[3])


def score_documents(docs: DataFrame, held_out, order: int = ORDER, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs: doc_id, text. held_out: boolean column; the model learns from the other documents only."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    parts = max(16, -(-input_bytes(docs) // PART_BYTES))
    read = stage(d.mapInArrow(read_blocks(block_bytes, parts), ROWS), "lm-blocks", by="kind").select("block", "kind", "pid", "data")
    known = [read.where(F.col("kind") == STATE)]
    total = kinds = 0

    def asking(counted: int, total: int, kinds: int):
        return lambda rows: Block(rows, parts, counted, total, kinds, least).messages()

    def adding(rows: pa.Table) -> pa.Table:
        kind, pid = rows.column("kind")[0].as_py(), rows.column("pid")[0].as_py()
        asked = sorted(zip(rows.column("block").to_pylist(), rows.column("data").to_pylist()))
        blocks, data = [b for b, _ in asked], [x for _, x in asked]
        return rows_of(list(add_words(pid, blocks, data, parts) if kind == 1 else add_longer(kind, pid, blocks, data, least, kind == order)))

    for k in range(order):
        asked = reduce(DataFrame.unionByName, known).groupBy("block").applyInArrow(asking(k, total, kinds), ROWS) if k else read.where("kind = 1")
        got = stage(asked.groupBy("kind", "pid").applyInArrow(adding, ROWS), "lm-answers")
        known.append(got.where("block >= 0"))
        del asked
        free_shuffles(spark)
        if k == 0:
            sums = [unpack(bytes(r.data))[0] for r in got.where("block < 0").collect()]  # one row a part
            total, kinds = (sum(int(x[i]) for x in sums) for i in range(2))
            unstage(read, "kind=1")

    def answer(rows: pa.Table) -> pa.Table:
        return Block(rows, parts, order, total, kinds, least).scores()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return reduce(DataFrame.unionByName, known).groupBy("block").applyInArrow(answer, schema)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 7) == 2)
