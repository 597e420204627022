"""Exact Jaccard join of documents on word n-grams, with a prefix tree over globally ordered sets.

A document's set holds the 63-bit hashes of its distinct n-grams, with the top bit set for those that are frequent in the
corpus; sorted by this number, rare n-grams come first, everywhere in the same order. Documents of the same word sequence are one node.

1. One pass hashes every text and gives each document its node and size. n-grams of a sample of the nodes are counted to know
   the frequent ones; at most ``MOST_OFTEN`` are told to all tasks.
2. A second pass sends each node's prefix, which any similar node's prefix must meet. Nodes that meet in rare n-grams are
   counted by pair, and pairs with fewer common prefix members than similarity implies are out. Nodes that meet in a frequent n-gram
   are tied to the n-gram itself, one edge each, so no group's pairs are written out.
3. Connected components of what is left are small worlds of near copies. A third pass sends the sets of their nodes only, once each,
   to the task of their component (large ones are dealt over blocks, and every pair of blocks is a task).
4. A world of more than ``CROWD`` sets is parted there by prefixes in an order of its own (rare in the world first), and thinned out: a center
   is compared with all sets of its part by lists of owners, those linked with it are settled, and the triangle inequality says which
   others can be linked with them. What is left is parted again, so a crowd of near copies costs in proportion to its members.
   Small worlds and small parts go into a prefix tree, set by set. A set traverses the tree with the members it shares so far, leaving out a
   subtree when the longest possible remainder cannot reach the threshold, or when all of it is linked with the set already.
   At a leaf the count of common members is exact, and decides.

Defined cases. Null or wordless text: empty set, linked with nothing. Fewer than n words: the sequence is the one n-gram. Copies, repeated
rows and ties are linked like all others; rows with a null doc_id keep it and have it as component if alone. Other columns are ignored.
Hash collisions (63 bits) are taken as equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.common import free_shuffles, fresh, row_hash, stage, table
from timeloom.llm.graph import components

N = 5
PERCENT = 75
#: N-grams in OFTEN nodes or more of a sample (one node in SAMPLE, by hash) count as frequent: the MOST_OFTEN most frequent of them, which bounds what
#: is broadcast. This decides the global order only; any order gives the same links.
SAMPLE, OFTEN, MOST_OFTEN = 8, 6, 1 << 20
FEW = 128  # meetings in an n-gram of so many nodes are counted by pair
HOT = np.uint64(1 << 63)
BLOCK_MEMBERS = 2_000_000
CROWD = 32  # worlds of more sets are thinned out before a tree gets what is left of them
CACHE = 400_000


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) >> 1
        return h


def shingles(words: list[bytes], of: WordHash, n: int = N) -> np.ndarray:
    """The set of a document, as sorted 63-bit numbers."""
    if not words:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(of.__getitem__, words), np.int64, len(words)).view(np.uint64)
    width = min(n, len(a))
    m = len(a) - width + 1
    h = np.full(m, width, np.uint64)
    for i in range(width):
        h = (h ^ a[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1))


def node_of(words: list[bytes]) -> int | None:
    """The number of a word sequence; none for an empty one."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) >> 1 if words else None


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; bytes.split() separates at exactly space and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "replace").lower().split()


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def common_needed(x, y, percent: int):
    """The least intersection of sets of sizes x and y that are similar enough."""
    return -(-percent * (x + y) // (100 + percent))


def survey(n: int):
    """(doc_id, text, row) to rows of kind 0: doc_id, row, node, size; kind 1: an n-gram (in node) of a node in the sample, from the half of its set that may come into a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = WordHash(), set()
        for batch in batches:
            nodes, sizes, halves = [], [], [np.empty(0, np.uint64)]
            for text in batch.column(1):
                words = words_of(text.as_py())
                node, s = node_of(words), shingles(words, of, n)
                nodes.append(node)
                sizes.append(len(s))
                if node is not None and node % SAMPLE == 0 and node not in seen:
                    seen.add(node)
                    halves.append(s[: len(s) // 2 + 1])
            if len(seen) > CACHE:
                seen.clear()
            k = batch.num_rows
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(k, np.int32)), "doc_id": batch.column(0), "row": batch.column(2), "node": pa.array(nodes, pa.int64()), "n": pa.array(sizes, pa.int64())})
            g = np.concatenate(halves).view(np.int64)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(g), np.int32)), "doc_id": pa.nulls(len(g), pa.int64()), "row": pa.nulls(len(g), pa.int64()), "node": pa.array(g), "n": pa.nulls(len(g), pa.int64())})

    return run


def ordered(words: list[bytes], of: WordHash, hot: np.ndarray, n: int) -> np.ndarray:
    """The set in the global order, frequent members last and marked by the top bit."""
    s = shingles(words, of, n)
    if len(hot) and len(s):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        is_hot = hot[at] == s
        if is_hot.any():
            s = np.concatenate([s[~is_hot], s[is_hot] | HOT])
    return s


def prefixes(shared, n: int, percent: int):
    """(text) to (gram, node, n, salt), once for each node of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen, hot = WordHash(), set(), shared.value
        for batch in batches:
            grams, nodes, sizes, counts = [], [], [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                node = node_of(words)
                if node is None or node in seen:
                    continue
                seen.add(node)
                s = ordered(words, of, hot, n)
                p = s[: prefix_length(len(s), percent)]
                grams.append(p)
                nodes.append(node)
                sizes.append(len(s))
                counts.append(len(p))
            if len(seen) > CACHE:
                seen.clear()
            if grams:
                g, node = np.concatenate(grams), np.repeat(np.array(nodes, np.int64), counts)
                salt = np.where(g >= HOT, node & 255, 0)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(g.view(np.int64)), "node": pa.array(node), "n": pa.array(np.repeat(np.array(sizes, np.int32), counts)), "salt": pa.array(salt.astype(np.int32))})

    return run


def meetings(percent: int, few: int):
    """Rows sorted by gram and node to (a, b, na, nb, c): pairs counted within the batch, or c null: the node tied to the gram."""

    def pairs(g, node, n) -> Iterator[pa.RecordBatch]:
        if not len(g):
            return
        new = np.r_[True, (g[1:] != g[:-1]) | (node[1:] != node[:-1])]
        g, node, n = g[new], node[new], n[new]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[start, len(g)])
        each = np.repeat(size, size)
        tied = (each > few) | (g < 0)  # a frequent gram has the top bit, and so is negative here
        if tied.any():
            yield tie(g[tied], node[tied])
        some = ~tied & (each > 1)
        g, node, n = g[some], node[some], n[some]
        for d in range(1, int(each[some].max()) if len(g) else 0):
            same = g[d:] == g[:-d]
            if not same.any():
                break
            na, nb = n[:-d][same].astype(np.int64), n[d:][same].astype(np.int64)
            ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            a, b = node[:-d][same][ok], node[d:][same][ok]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "na": pa.array(na[ok].astype(np.int32)), "nb": pa.array(nb[ok].astype(np.int32)), "c": pa.array(np.ones(len(a), np.int64))})

    def tie(g, node) -> pa.RecordBatch:
        k = len(g)
        return pa.RecordBatch.from_pydict({"a": pa.array(node), "b": pa.array(~(g & ((1 << 62) - 1))), "na": pa.nulls(k, pa.int32()), "nb": pa.nulls(k, pa.int32()), "c": pa.nulls(k, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, large = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)], None
        for batch in batches:
            now = [np.concatenate([r, np.asarray(batch.column(k))]) for k, r in enumerate(rest)]
            if not len(now[0]):
                continue
            if large is not None:  # more of a gram that has been found to be common
                k = int(np.searchsorted(now[0], large, "right"))
                yield tie(now[0][:k], now[1][:k])
                now, large = [x[k:] for x in now], large if k == len(now[0]) else None
                if not len(now[0]):
                    rest = now
                    continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last gram may go on in the next batch
            yield from pairs(*(x[:cut] for x in now))
            rest = [x[cut:] for x in now]
            if len(np.unique(rest[1])) > few:  # known to be common: nothing of it is held back
                large = int(rest[0][0])
                yield tie(rest[0], rest[1])
                rest = [x[:0] for x in rest]
        yield from pairs(*rest)

    return run


def sets_of(shared, n: int):
    """(hash of doc_id, text) to (node, members), for the documents that the sketch may hold; a null id counts as held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, sketch = shared.value
        of, mask = WordHash(), len(sketch) * 64 - 1
        for batch in batches:
            h = np.asarray(batch.column(0)) & mask
            held = (sketch[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) != 0
            nodes, sets = [], []
            for k in np.flatnonzero(held).tolist():
                words = words_of(batch.column(1)[k].as_py())
                node = node_of(words)
                if node is not None:
                    nodes.append(node)
                    sets.append(ordered(words, of, hot, n).tobytes())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "members": pa.array(sets, pa.binary())})

    return run


class Tree:
    """A prefix tree over ordered sets, one edge for each unbranched run of members, with links kept as a forest."""

    class Node:
        __slots__ = ("whose", "start", "end", "next", "least", "most", "own", "one")

        def __init__(self, whose: int, start: int, end: int, size: int):
            self.whose, self.start, self.end = whose, start, end
            self.next: dict = {}
            self.least = self.most = size
            self.own: list[int] = []  # sets that end here
            self.one: int | None = whose  # a set whose component all below are known to share, or None

    def __init__(self, percent: int):
        self.percent = percent
        self.sets: list[np.ndarray] = []
        self.parent: list[int] = []
        self.root = Tree.Node(0, 0, 0, 0)
        self.root.least, self.root.one = 1 << 60, None

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, s: np.ndarray) -> None:
        x = len(self.sets)
        self.sets.append(s)
        self.parent.append(x)
        if x:
            self.seek(self.root, s, x, 0)
        self.insert(s, x)

    def seek(self, node: Node, s: np.ndarray, x: int, shared: int) -> None:
        """Link x with every component below ``node`` that holds a similar set; ``shared``: members common with the path to it."""
        stack = [(node, shared)]
        opened = []
        while stack:
            node, shared = stack.pop()
            if node.one is not None and self.find(node.one) == self.find(x):
                continue
            if node.end > node.start:
                run = self.sets[node.whose][node.start : node.end]
                at = np.searchsorted(s, run)
                at[at == len(s)] = 0
                shared += int((s[at] == run).sum())
                passed = int(np.searchsorted(s, run[-1], "right"))
                if shared + min(node.most - node.end, len(s) - passed) < common_needed(len(s), max(node.least, node.end), self.percent):
                    continue
            for y in node.own:
                if self.find(y) != self.find(x) and shared >= common_needed(len(s), len(self.sets[y]), self.percent):
                    self.parent[self.find(y)] = self.find(x)
            if node.next:
                opened.append(node)
                first = list(node.next)
                known = np.isin(np.array(first, np.uint64), s)
                # those that go on with a member of s come off the stack first
                for k in np.argsort(known, kind="stable").tolist():
                    stack.append((node.next[first[k]], shared))
        for node in reversed(opened):
            below = {self.find(c.one) if c.one is not None else -1 for c in node.next.values()} | {self.find(y) for y in node.own}
            if len(below) == 1 and -1 not in below:
                node.one = next(iter(below))

    def insert(self, s: np.ndarray, x: int) -> None:
        node, at = self.root, 0
        while True:
            node.least, node.most = min(node.least, len(s)), max(node.most, len(s))
            if node.one is not None and self.find(node.one) != self.find(x):
                node.one = None
            if at == len(s):
                node.own.append(x)
                return
            child = node.next.get(int(s[at]))
            if child is None:
                leaf = Tree.Node(x, at, len(s), len(s))
                leaf.own.append(x)
                node.next[int(s[at])] = leaf
                return
            run, mine = self.sets[child.whose][child.start : child.end], s[at : at + child.end - child.start]
            k = min(len(run), len(mine))
            off = np.flatnonzero(run[:k] != mine[:k])
            same = int(off[0]) if len(off) else k
            if same < len(run):  # split the edge
                upper = Tree.Node(child.whose, child.start, child.start + same, 0)
                upper.least, upper.most, upper.one = child.least, child.most, child.one
                child.start += same
                upper.next[int(run[same])] = child
                node.next[int(s[at])] = upper
                child = upper
            node, at = child, at + same


class Forest:
    """Links, kept as a forest."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, others) -> None:
        for y in others:
            self.parent[self.find(y)] = self.find(x)


class Crowd:
    """Sets with a list of owners for each member, every set sorted anew: members that are rare among these sets come first."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, len(sets)
        self.n = np.array([len(s) for s in sets], np.int64)
        self.start = np.r_[0, np.cumsum(self.n)]
        members = np.concatenate(sets)
        order = np.argsort(members)
        members = members[order]
        new = np.r_[True, members[1:] != members[:-1]]
        del members
        count = np.diff(np.r_[np.flatnonzero(new), len(new)])
        by_count = np.argsort(count, kind="stable")
        self.count = count[by_count]
        rank = np.empty(len(count), np.int32)
        rank[by_count] = np.arange(len(count), dtype=np.int32)
        self.ids = np.empty(len(order), np.int32)
        self.ids[order] = rank[np.cumsum(new, dtype=np.int32) - 1]
        del order, new, by_count, rank
        key = self.owner() * np.int64(len(count))
        key += self.ids
        key.sort()
        key %= len(count)
        self.ids[:] = key
        del key
        self.owners = self.owner()[np.argsort(self.ids, kind="stable")]
        self.first = np.r_[0, np.cumsum(self.count)]

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.size, dtype=np.int32), self.n)

    def parts(self) -> list[np.ndarray]:
        """Sets of different parts are not linked: their prefixes do not meet, nor do those of others between them."""
        p = prefix_length(self.n, self.percent)
        owner = np.repeat(np.arange(self.size, dtype=np.int32), p)
        ids = self.ids[np.arange(len(owner)) + np.repeat(self.start[:-1] - np.cumsum(p) + p, p)]
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        new = np.r_[True, ids[1:] != ids[:-1]]
        begin, gram = np.flatnonzero(new), np.cumsum(new) - 1
        label = np.arange(self.size)
        while True:
            lower = label.copy()
            np.minimum.at(lower, owner, np.minimum.reduceat(label[owner], begin)[gram])
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        order = np.argsort(label, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(label[order])) + 1)

    def common(self, x: int) -> np.ndarray:
        """How many members each set has in common with x."""
        ids = self.ids[self.start[x] : self.start[x + 1]]
        lists = [self.owners[self.first[g] : self.first[g + 1]] for g in ids[self.count[ids] > 1].tolist()]
        c = np.bincount(np.concatenate(lists), minlength=self.size) if lists else np.zeros(self.size, np.int64)
        c[x] = self.n[x]
        return c

    def thin(self, forest: Forest, names: np.ndarray) -> np.ndarray:
        """Link sets until half of them are settled; returns those left, which have no links to others that are still to be found.

        A center is compared with all sets. Those that it is linked with are in its component, and 1 - Jaccard similarity is a metric:
        they have no link to a set that is more than twice the allowed distance from the center. Sets in between are compared with all
        sets too, unless they are found in the center's component before.
        """
        left = np.ones(self.size, bool)
        typical = np.add.reduceat(self.count[self.ids], self.start[:-1]) / self.n
        for x in np.argsort(-typical, kind="stable").tolist():
            if 2 * left.sum() <= self.size:
                break
            if not left[x]:
                continue
            c = self.common(x)
            union = self.n + self.n[x] - c
            near = 100 * c >= self.percent * union
            forest.link(int(names[x]), names[near].tolist())
            left &= ~near
            for y in np.flatnonzero(left & (100 * c >= (2 * self.percent - 100) * union)).tolist():
                if forest.find(int(names[y])) != forest.find(int(names[x])):
                    d = self.common(y)
                    forest.link(int(names[y]), names[100 * d >= self.percent * (self.n + self.n[y] - d)].tolist())
                    left[y] = False
        return np.flatnonzero(left)


def roots_of(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set, the number of one in its component. Crowds are parted and thinned out until what is left goes into trees."""
    forest, work = Forest(len(sets)), [np.arange(len(sets))]
    while work:
        names = work.pop()
        if len(names) <= CROWD:
            tree = Tree(percent)
            for x in names.tolist():
                tree.add(sets[x])
            for k, x in enumerate(names.tolist()):
                forest.link(int(names[tree.find(k)]), [x])
            continue
        crowd = Crowd([sets[x] for x in names.tolist()], percent)
        parts = crowd.parts()
        work += [names[p] for p in parts if len(p) > 1] if len(parts) > 1 else [names[crowd.thin(forest, names)]]
    return [forest.find(x) for x in range(len(sets))]


def tree_join(percent: int):
    """Rows sorted by group to (node, other): each node with the smallest of those it is linked with in its group."""

    def linked(nodes: list[int], sets: list[bytes]) -> Iterator[pa.RecordBatch]:
        once = dict(zip(nodes, sets))
        names = sorted(once, key=lambda node: (len(once[node]), node))
        roots = roots_of([np.frombuffer(once[node], np.uint64) for node in names], percent)
        least: dict[int, int] = {}
        for r, node in zip(roots, names):
            least[r] = min(least.get(r, node), node)
        yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.int64()), "other": pa.array([least[r] for r in roots], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []
        for batch in batches:
            for *key, node, s in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if key != group:
                    if nodes:
                        yield from linked(nodes, sets)
                    group, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(s)
        if nodes:
            yield from linked(nodes, sets)

    return run


def classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Returns doc_id, row (see row_hash), node and n of each row, and node, component, first (doc_id) of each node."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = stage(d.select("doc_id", "text", row_hash().alias("row")).mapInArrow(survey(n), "kind int, doc_id long, row long, node long, n long"), "jaccard-survey")
    of_doc = seen.where("kind = 0").select("doc_id", "row", "node", "n")
    often = seen.where("kind = 1").groupBy("node").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN)
    often = often.orderBy(F.desc("c"), "node").limit(MOST_OFTEN).select("node").toArrow()
    hot = np.sort(np.asarray(often.column("node"), np.int64)).view(np.uint64)
    shared = spark.sparkContext.broadcast(hot)
    sent = d.select("text").mapInArrow(prefixes(shared, n, percent), "gram long, node long, n int, salt int")
    met = sent.repartition("gram", "salt").sortWithinPartitions("gram", "node").select("gram", "node", "n").mapInArrow(meetings(percent, FEW), "a long, b long, na int, nb int, c long")
    met = stage(met.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("c").alias("c")), "jaccard-met")
    free_shuffles(spark)
    need = common_needed_sql(percent)
    least = F.least(*[F.expr(f"{need} - {prefix_rest_sql(k, percent)} + 1") for k in ("na", "nb")])
    edges = met.where(F.col("c").isNull() | (F.col("c") >= least)).select("a", "b")
    first = stage(of_doc.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n")), "jaccard-first")
    world = stage(components(edges).where("node >= 0").withColumnRenamed("component", "world").join(first, "node"), "jaccard-world")  # n-grams have negative numbers
    world = world.join(world.groupBy("world").agg(F.ceil(F.sum("n") / BLOCK_MEMBERS).cast("int").alias("blocks")), "world")
    # a sketch of the first document of each node: only they send their sets
    bits = max(1 << 12, min(1 << 24, 1 << (32 * world.count()).bit_length()))
    h = F.xxhash64(F.coalesce("first", F.lit(0)))
    rows = world.select(h.bitwiseAND(F.lit(bits - 1)).alias("at")).groupBy(F.expr("at >> 6").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("word")).toArrow()
    sketch = np.zeros(bits // 64, np.int64)
    sketch[np.asarray(rows.column("slot"), np.int64)] = np.asarray(rows.column("word"), np.int64)
    shared = spark.sparkContext.broadcast((hot, sketch.view(np.uint64)))
    sets = d.select(F.xxhash64(F.coalesce("doc_id", F.lit(0))), "text").mapInArrow(sets_of(shared, n), "node long, members binary").join(world.select("node", "world", "blocks"), "node")
    dealt = sets.withColumn("x", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).otherwise(0))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.select("world", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "node", "members")
    links = groups.repartition("world", "lo", "hi").sortWithinPartitions("world", "lo", "hi").mapInArrow(tree_join(percent), "node long, other long")
    if world.where("blocks > 1").limit(1).count():  # links of a world that was dealt over blocks are still to be put together
        found = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    else:
        found = links.select("node", F.col("other").alias("component"))
    whole = stage(first.drop("n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-nodes")
    return of_doc, whole


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    of_doc, whole = classes(docs, n, percent)
    smallest = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    names = whole.join(smallest, "component").select("node", "component_id")
    return of_doc.join(names, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def common_needed_sql(percent: int) -> str:
    return f"((cast(na as long) + nb) * {percent} + {100 + percent} - 1) div {100 + percent}"


def prefix_rest_sql(size: str, percent: int) -> str:
    """What of a set's size its prefix leaves, plus 1."""
    return f"(cast({size} as long) * {percent} + 99) div 100"


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each group of similar texts: that of the smallest doc_id (null is the greatest), of equal ones by hash. Texts without words all stay."""
    of_doc, whole = classes(docs, n, percent)
    (name,) = fresh(docs, "row")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    keep = of_doc.join(whole.select("node", "component"), "node").groupBy("component").agg(F.min(rank)["row"].alias(name)).select(name)
    rows = docs.withColumn(name, row_hash())
    has_word = F.coalesce(F.regexp_like("text", F.lit("[^ \\t-\\r]")), F.lit(False))
    one = rows.where(has_word).join(keep, name).dropDuplicates([name])
    return one.unionByName(rows.where(~has_word)).drop(name)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, e.y FROM reach JOIN e ON e.x = reach.r)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d
"""
