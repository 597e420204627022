"""Line dedup with a segment-partition edit join.

Lines of at least ``least_chars`` characters (whole, as split at \\n) are put into classes of equal lines. A class's first line, by doc_id and line
number, stays and the others go. It goes too if a class within ``edits`` edits has an earlier first line. Lines that are shorter stay; with 0, none is shorter.

The edit join splits every line into edits + 1 segments and looks them up as substrings. Lines near in length share a bucket, in which segments are cut at the
same places: the first ones from the line's start, the last ones from its end. Of two lines within the edits, some segment k is whole in both, with
at most k edits before it and edits - k after it, so it stands at its own place in the one and shifted by no more than that in the other. A line is indexed
under its segments, and probes with the substrings at these shifts (for one edit no shift is left, and probes and index agree). Keys are hashed with bucket and segment
number, and only keys of two lines or more are joined. Candidates are verified by a banded bit-parallel automaton: for each number of edits, the
bits of one machine word are the diagonals of the band, and one fold over the characters shifts and ors them.

For one edit, groups of more than ``FEW`` lines are not paired. Their lines are keyed anew by all but one of ``REGIONS`` regions, and what is crowded still, is cut to
the part in which the group's lines differ and grouped by that part with one character left out: lines that agree in it, at the same place,
differ in one character, and a line that is equal to it differs by an insertion. The least first line of a group decides, so work and rows are in proportion to the lines.
For more edits, groups of any size are paired. Only DataFrame operations are used.

Lines travel as hashes (64 bits, with 32 others for equality) with their length; text is fetched for candidates only (through a Bloom filter of bounded size, then
a join). For each document the numbers of its lines that stay are gathered, and the text is filtered in place.

Defined cases. A null text has no lines and stays null. Rows that repeat both doc_id and text are one document and are treated alike. A null doc_id comes
first. A document that had a line with a word and keeps none has ``emptied`` set. Other columns pass through, unless they carry
the name of an output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeloom.llm.common import fresh, stage, table
from timeloom.llm.url_filters import holds, spots

EDITS = 1
LEAST_CHARS = 10
#: Lines at least so long for each segment take part in the edit join; shorter ones match too easily.
SEGMENT_CHARS = 10
MOST_BITS = 1 << 26
#: Lengths that share keys, the size of a group that is paired, and the number of regions that part larger ones.
BUCKET = 16
FEW = 16
REGIONS = 8
WORD = "[^ \\t-\\r]"


def lines_of(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, _sum (hash of the text), line number and line, for lines of at least ``least_chars`` characters."""
    each = docs.select("doc_id", F.xxhash64("text").alias("_sum"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return each.where(F.length("line") >= least_chars)


def line_hash(line: Column) -> Column:
    return F.xxhash64(line, F.length(line))


def in_buckets(line: Column, edits: int, keys) -> Column:
    """``keys`` of the bucket of a line's length, and of the next one if lines of that are within the edits. A bucket's shortest line gives the cuts."""
    n = F.length(line).cast("long")
    least = lambda bucket: bucket * BUCKET - edits
    own = F.floor(n / BUCKET)
    return F.concat(keys(own, least(own)), F.when(n % BUCKET >= BUCKET - edits, keys(own + 1, least(own + 1))).otherwise(F.array().cast("array<bigint>")))


def segment_keys(line: Column, edits: int) -> Column:
    """The keys of a line: of its segments, and of the substrings at which another line's segments may stand in it."""
    n, parts = F.length(line).cast("long"), edits + 1

    def keys(bucket: Column, least: Column) -> Column:
        out = []
        for k in range(parts):
            start, end = F.floor(least * k / parts), F.floor(least * (k + 1) / parts)
            shifts = min(k, edits - k)
            for shift in range(-shifts, shifts + 1):
                at = (start if k <= edits - k else n - least + start) + shift
                key = F.xxhash64(bucket, F.lit(k), F.substring(line, F.greatest(at, F.lit(0)).cast("int") + 1, (end - start).cast("int")))
                out.append(key if shift == 0 else F.when((at >= 0) & (at + end - start <= n), key))
        return F.array(*out) if edits == 1 else F.array_compact(F.array_distinct(F.array(*out)))

    return in_buckets(line, edits, keys)


def region_rows(lines: DataFrame) -> DataFrame:
    """lines(h, line) to (key, h, mid), for one edit: a key is all of the line but one region, which is ``mid``. An edit lies in one region, so what is
    before it (from the start) and after it (from the end) is common to both lines."""
    line = F.col("line")
    n = F.length(line).cast("long")

    def rows(bucket: Column, least: Column) -> Column:
        cut = lambda i: F.floor(least * i / REGIONS).cast("int")
        tail = lambda i: (least - cut(i + 1)).cast("int")
        one = lambda i: F.struct(F.xxhash64(bucket, i, F.substring(line, F.lit(1), cut(i)), F.right(line, tail(i))).alias("key"), F.substring(line, cut(i) + 1, (n - cut(i) - tail(i)).cast("int")).alias("mid"))
        return F.transform(F.sequence(F.lit(0), F.lit(REGIONS - 1)), one)

    own = F.floor(n / BUCKET)
    every = F.when(n % BUCKET == BUCKET - 1, F.concat(rows(own, own * BUCKET - 1), rows(own + 1, own * BUCKET + BUCKET - 1))).otherwise(rows(own, own * BUCKET - 1))
    return lines.select("h", F.explode(every).alias("r")).select("r.key", "h", "r.mid")


def within(a: str, b: str, edits: int) -> Column:
    """Whether two array columns of characters are at most ``edits`` edits apart: banded, bit-parallel over the band's diagonals."""
    width, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    shift = lambda x, k: F.shiftleft(x, k) if k > 0 else F.shiftright(x, -k)
    levels = [f"r{e}" for e in range(edits + 1)]
    first = [sum(1 << (edits + d) for d in range(e + 1)) for e in range(edits + 1)]
    start = F.struct(F.lit(0).alias("j"), *[F.lit(x).cast("long").alias(n) for n, x in zip(levels, first)])

    def step(acc: Column, char: Column) -> Column:
        bits = [F.when(F.get(a, acc["j"] + (d - edits)) == char, F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long")) for d in range(width)]
        same = reduce(lambda x, y: x.bitwiseOR(y), bits)
        out: list[Column] = []
        for e, name in enumerate(levels):
            r = acc[name].bitwiseAND(same)
            if e:
                old = acc[levels[e - 1]]
                r = r.bitwiseOR(old).bitwiseOR(shift(old, -1)).bitwiseOR(shift(out[e - 1], 1)).bitwiseAND(F.lit(full).cast("long"))
            out.append(r)
        return F.struct((acc["j"] + 1).alias("j"), *[x.alias(n) for x, n in zip(out, levels)])

    last = F.aggregate(F.col(b), start, step, lambda acc: acc[levels[-1]])
    diagonal = F.size(a) - F.size(b) + edits
    inside = F.abs(F.size(a) - F.size(b)) <= edits
    return inside & (F.call_function("shiftright", last, F.greatest(diagonal, F.lit(0))).bitwiseAND(F.lit(1).cast("long")) != 0)


def sketch_of(keys: DataFrame, key: str) -> DataFrame:
    """One row with the words of a Bloom filter over a column, of at most MOST_BITS bits."""
    bits = max(1 << 10, min(MOST_BITS, 1 << (16 * keys.count()).bit_length()))
    at = keys.select(F.explode(F.array(*spots(F.col(key), 0, F.lit(bits)))).alias("at"))
    word = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("word"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("slot")).join(word, "slot", "left")
    return stage(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("word", F.lit(0)).cast("long").alias("word")))), lambda x: x["word"]).alias("words")), "line-sketch")


def pairs_of(rows: DataFrame) -> DataFrame:
    """rows(key, h): pairs a < b that share a key."""
    one, two = rows.select("key", F.col("h").alias("a")), rows.select("key", F.col("h").alias("b"))
    return one.join(two, "key").where("a < b").select("a", "b").distinct()


def common_start(a: Column, b: Column) -> Column:
    """The number of characters that two strings begin with alike."""
    most = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | (F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1))))), F.lit(0))


def starred(rows: DataFrame) -> DataFrame:
    """rows(key, h, mid, first), all of whose lines agree but for mid: h of those that have an earlier line within one edit, without pairs."""
    # the least and the greatest of some strings begin with what all of them begin with
    ends = rows.groupBy("key").agg(F.min("mid").alias("lo"), F.max("mid").alias("hi"), F.min(F.reverse("mid")).alias("lo_r"), F.max(F.reverse("mid")).alias("hi_r"), F.min(F.length("mid")).alias("least"))
    head = common_start(F.col("lo"), F.col("hi"))
    ends = ends.select("key", head.alias("head"), F.least(common_start(F.col("lo_r"), F.col("hi_r")), F.col("least") - head).alias("tail"))
    cut = rows.join(ends, "key").select("key", "h", "first", F.expr("substring(mid, head + 1, length(mid) - head - tail)").alias("mid"))
    # what is left with each character left out (place p), and whole (p = -1)
    left_out = F.when(F.length("mid") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length("mid"), F.lit(1))), lambda i: F.struct(i.alias("p"), F.concat(F.substring(F.col("mid"), F.lit(1), i - 1), F.substring(F.col("mid"), i + 1, F.length("mid"))).alias("s")))).otherwise(F.array().cast("array<struct<p:int,s:string>>"))
    each = cut.select("key", "h", "first", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("p"), F.col("mid").alias("s"))), left_out)).alias("v")).select("key", "h", "first", "v.p", "v.s")
    same, near = W.partitionBy("key", "s", "p"), W.partitionBy("key", "s")
    longer = F.col("p") >= 0
    least = each.withColumns({"at_place": F.min("first").over(same), "whole": F.min(F.when(~longer, F.col("first"))).over(near), "part": F.min(F.when(longer, F.col("first"))).over(near)})
    earlier = F.when(longer, F.least(F.col("at_place"), F.coalesce("whole", "at_place"))).otherwise(F.coalesce("part", "first"))
    return least.where(earlier < F.col("first")).select("h").distinct()


def candidates(long_lines: DataFrame, classes: DataFrame, edits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs (a, b), the texts (h, line) of all lines in them, and what is known to go (h) without pairs."""
    keyed_lines = long_lines.withColumn("key", F.explode(segment_keys(F.col("line"), edits)))
    shared = stage(keyed_lines.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key"), "line-shared")
    hits = keyed_lines.withColumn("_f", sketch_of(shared, "key").scalar()).where(holds(F.col("key"), 0, F.col("_f"))).select("key", "h", "line")
    rows = stage(hits.groupBy("key", "h").agg(F.first("line").alias("line")).join(shared, "key"), "line-rows")
    texts = stage(rows.groupBy("h").agg(F.first("line").alias("line")), "line-texts")
    rows = rows.select("key", "h")
    if edits > 1:
        return stage(pairs_of(rows), "line-candidates"), texts, texts.select("h").limit(0)
    sized = rows.join(rows.groupBy("key").agg(F.count("h").alias("n")), "key")
    found = pairs_of(sized.where(F.col("n") <= FEW))
    crowded = region_rows(sized.where(F.col("n") > FEW).select("h").distinct().join(texts, "h"))
    parted = stage(crowded.groupBy("key").agg(F.count("h").alias("n")).where("n > 1").join(crowded, "key"), "line-regions")
    found = stage(found.union(pairs_of(parted.where(F.col("n") <= FEW).select("key", "h"))).distinct(), "line-candidates")
    return found, texts, starred(parted.where(F.col("n") > FEW).join(classes.select("h", "first"), "h"))


def near_lines(lines: DataFrame, classes: DataFrame, edits: int) -> DataFrame:
    """Classes (h) that have a class within ``edits`` edits with an earlier first line."""
    long_lines = lines.where(F.length("line") >= SEGMENT_CHARS * (edits + 1)).select(line_hash(F.col("line")).alias("h"), "line")
    found, some, gone = candidates(long_lines, classes, edits)
    texts = some.join(found.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "h").join(classes.select("h", "first"), "h")
    texts = stage(texts.select("h", "first", F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0)).alias("chars")), "line-chars")
    a, b = texts.select(*[F.col(c).alias(f"a_{c}") for c in texts.columns]), texts.select(*[F.col(c).alias(f"b_{c}") for c in texts.columns])
    pairs = found.join(a, F.col("a") == F.col("a_h")).join(b, F.col("b") == F.col("b_h")).where(within("a_chars", "b_chars", edits))
    return pairs.select(F.when(F.col("a_first") < F.col("b_first"), F.col("b")).otherwise(F.col("a")).alias("h")).union(gone).distinct()


def dedup_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Adds n_lines (that count), n_removed and emptied, and replaces text by what stays."""
    lines = lines_of(docs, least_chars)
    # the first line of each class; null ids come first, as nulls are smallest in a struct
    first = F.min(F.struct("doc_id", "_sum", "no")).alias("first")
    classes = stage(lines.select(line_hash(F.col("line")).alias("h"), F.crc32(F.col("line").cast("binary")).alias("crc"), "doc_id", "_sum", "no").groupBy("h", "crc").agg(first), "line-classes")
    gone = near_lines(lines, classes, edits)
    i, s, x, had, kept, each, own = fresh(docs, "id", "s", "x", "had", "kept", "lines", "stays")
    stays = classes.join(gone, "h", "left_anti").groupBy("first.doc_id", "first._sum").agg(F.sort_array(F.collect_list("first.no")).alias(own))
    stays = stays.select(F.col("doc_id").alias(i), F.col("_sum").alias(s), own)
    rows = docs.drop("n_lines", "n_removed", "emptied").withColumn(x, F.xxhash64("text"))
    met = rows.join(stays, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(x) == F.col(s)), "left")
    met = met.withColumns({each: F.split("text", "\n", -1), own: F.coalesce(own, F.array().cast("array<int>"))})
    met = met.withColumn(kept, F.filter(each, lambda line, at: (F.length(line) < least_chars) | F.array_contains(F.col(own), at)))
    has_word = lambda c: F.coalesce(F.regexp_like(c, F.lit(WORD)), F.lit(False))
    met = met.withColumns({"n_lines": F.coalesce(F.size(F.filter(each, lambda line: F.length(line) >= least_chars)), F.lit(0)).cast("long"), "n_removed": F.greatest(F.size(each) - F.size(kept), F.lit(0)).cast("long"), had: has_word(F.col("text")), "text": F.when(F.col("text").isNotNull(), F.array_join(kept, "\n"))})
    return met.withColumn("emptied", F.col(had) & ~has_word(F.col("text"))).drop(i, s, x, had, kept, each, own)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "emptied", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


#: For one edit. That two lines are at most one edit apart is said here by their common ends, not by a distance.
OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), c AS (SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM l WHERE length(line) >= 10 GROUP BY line),
p AS (
  SELECT a.line AS x, b.line AS y, a.n AS nx, b.n AS ny, a.first AS fx, b.first AS fy FROM c a JOIN c b ON left(a.line, a.n // 2) = left(b.line, a.n // 2)
  WHERE a.n >= 20 AND b.n >= 20 AND b.n - a.n IN (0, 1) AND a.line <> b.line
  UNION
  SELECT a.line, b.line, a.n, b.n, a.first, b.first FROM c a JOIN c b ON right(a.line, a.n // 2) = right(b.line, a.n // 2)
  WHERE a.n >= 20 AND b.n >= 20 AND b.n - a.n IN (0, 1) AND a.line <> b.line
), near AS (
  SELECT *, list_bool_or(list_transform(generate_series(1, ny), lambda i: left(x, i - 1) = left(y, i - 1) AND substr(x, CASE WHEN nx = ny THEN i + 1 ELSE i END) = substr(y, i + 1))) AS ok FROM p
), gone AS (SELECT CASE WHEN fx < fy THEN y ELSE x END AS line FROM near WHERE ok),
f AS (
  SELECT l.doc_id, l.no, l.line, length(l.line) < 10 OR ((l.doc_id, l.no) = c.first AND l.line NOT IN (SELECT line FROM gone)) AS stays
  FROM l LEFT JOIN c USING (line)
), t AS (
  SELECT doc_id, count(*) FILTER (length(line) >= 10) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (stays), '') AS kept FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(regexp_matches(d.text, '[^\x20\x09-\x0D]') AND NOT regexp_matches(kept, '[^\x20\x09-\x0D]'), false) AS emptied,
  length(kept) AS n_chars, sha256(kept) AS text_sha256
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""
