"""URL filters: prefix rules first, then a Bloom filter cascade over hosts.

The cascade holds a list of blocked domains exactly, relative to the corpus's complete key universe: level 0 encodes the listed
keys, level 1 the other keys of the universe that level 0 takes for listed, level 2 the listed keys that level 1 takes for
such, and so on until a level has no false positive. A key is listed if the first level that misses it is odd. Every key of the
universe is then answered rightly and no row is joined with the list.

Keys are the domains of a host: the host itself and every suffix after a dot. A url is blocked if any of its domains is listed.

Sizes. A level is built from 64-bit words of bits that are or-ed per word; its bits are ``bits_per_key`` times its keys. While the
levels together take at most ``most_bytes`` they are scalar subqueries, shipped with each task. Beyond that, keys are split over
shards by hash, each with levels of its own; rows then meet their shard's levels by an equi-join on the shard number
(not on the key), salted so that a hot host does not land in one task.

Defined cases. A null url, or one without ``://``, has an empty host and path: no rule fits and it is allowed. An empty list blocks nothing. Ties
and repeated rows are judged alike; columns of the input pass through unless they carry the name of an output.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.common import LOWER, UPPER, ascii_lower, fresh, stage, table

#: (host, path, verdict), as the contract fixes them.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Families of blocked domains under each top-level domain of the pages, with all their subdomains.
BLOCKED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Hosts of the pages whose md5 begins so are listed too: a stand-in for a long list of single hosts, one in sixteen.
LISTED_MD5 = "0"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HASHES = 3
MOST_LEVELS = 64


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    first = lambda out: F.coalesce(*[F.when(fits(h, p), F.lit(out(h, p, v))) for h, p, v in ordered], F.lit(None).cast("string"))
    return first(lambda h, p, v: h + p), first(lambda h, p, v: v)


def domains(host: Column) -> Column:
    """``a.b.c`` gives a.b.c, b.c and c; none for an empty host."""
    parts = F.split(host, "\\.", -1)
    n = F.size(parts)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")))


def spots(key: Column, level: int, bits: Column) -> list[Column]:
    """The bit positions of a key at a level, in a filter of ``bits`` bits."""
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + k)), bits) for k in range(HASHES)]


def holds(key: Column, level: int, words: Column) -> Column:
    """Whether the filter ``words`` (array of 64-bit words) may hold the key; false for an empty filter."""
    bits = F.size(words).cast("long") * 64
    bit = lambda at: F.get(words, F.floor(at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))) != 0
    return F.when(bits == 0, F.lit(False)).otherwise(reduce(lambda a, b: a & b, map(bit, spots(key, level, F.greatest(bits, F.lit(1))))))


def level_table(keys: DataFrame, level: int, bits_per_key: int) -> DataFrame:
    """keys(shard, key) as one row a shard: the words of its filter, sized by its number of keys."""
    sizes = keys.groupBy("shard").agg((F.ceil(F.count("key") * bits_per_key / 64) * 64).cast("long").alias("bits"))
    at = keys.join(sizes, "shard").select("shard", "bits", F.explode(F.array(*spots(F.col("key"), level, F.col("bits")))).alias("at"))
    word = at.groupBy("shard", "bits", F.floor(F.col("at") / 64).cast("int").alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("word"))
    got = word.groupBy("shard", "bits").agg(F.map_from_entries(F.collect_list(F.struct("slot", "word"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), (F.col("bits") / 64 - 1).cast("int")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    return got.select("shard", dense.alias("words"))


class Cascade:
    """Levels of filters that answer membership exactly for every key of the universe they were built over."""

    def __init__(self, universe: DataFrame, listed: DataFrame, bits_per_key: int = 8, most_bytes: int = 1 << 20, shard_bytes: int = 1 << 18):
        """universe(key), listed(key): distinct or not, nulls are ignored. Listed keys count as part of the universe."""
        self.spark = universe.sparkSession
        good = listed.select("key").where(F.col("key").isNotNull()).distinct().withColumn("listed", F.lit(True))
        every = stage(universe.select("key").where(F.col("key").isNotNull()).distinct().join(good, "key", "full").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "url-universe")
        n, whole = every.agg(F.count_if("listed"), F.count("key")).first()
        wrong = (1 - math.exp(-HASHES / bits_per_key)) ** HASHES  # share of keys that a level takes for its own
        size = math.ceil((n + wrong * (whole - n)) / (1 - wrong) * bits_per_key / 8)  # level 0 holds the listed keys, level 1 its errors among the others, and so on
        self.shards = 1 if size <= most_bytes else -(-size // shard_bytes)
        every = every.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(self.shards)).cast("int"))
        self.levels: list[DataFrame] = []
        code, other = every.where("listed"), every.where(~F.col("listed"))
        while code.limit(1).count():
            if len(self.levels) == MOST_LEVELS:
                raise ValueError("the cascade does not end; raise bits_per_key")
            k = len(self.levels)
            made = stage(level_table(code.select("shard", "key"), k, bits_per_key), "url-level")
            self.levels.append(made)
            met = other.join(made, "shard", "left") if self.shards > 1 else other.withColumn("words", made.select("words").scalar())
            wrong = stage(met.where(holds(F.col("key"), k, F.coalesce("words", F.array().cast("array<bigint>")))).select("key", "listed", "shard"), "url-wrong")
            code, other = wrong, code

    def flag(self, df: DataFrame, keys: str, out: str) -> DataFrame:
        """Adds the boolean ``out``: whether any key of the array column ``keys`` is listed."""
        if not self.levels:
            return df.withColumn(out, F.lit(False))
        none = F.array().cast("array<bigint>")
        if self.shards == 1:
            names = fresh(df, *[f"l{k}" for k in range(len(self.levels))])
            df = df.withColumns({name: made.select("words").scalar() for name, made in zip(names, self.levels)})
            verdict = F.coalesce(F.exists(keys, lambda x: self._walk(x, list(map(F.col, names)))), F.lit(False))
            return df.withColumn(out, verdict).drop(*names)
        salts = 16
        packed = reduce(lambda a, b: a.join(b, "shard", "full"), [made.withColumnRenamed("words", f"_l{k}") for k, made in enumerate(self.levels)])
        packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        (row,) = fresh(df, "row")
        rows = stage(df.withColumn(row, F.monotonically_increasing_id()), "url-rows")
        each = rows.select(row, F.explode(keys).alias("_key")).withColumns({"shard": F.pmod(F.xxhash64("_key", F.lit(-1)), F.lit(self.shards)).cast("int"), "_salt": F.pmod(row, F.lit(salts)).cast("int")})
        hit = each.join(packed, ["shard", "_salt"]).where(self._walk(F.col("_key"), [F.coalesce(f"_l{k}", none) for k in range(len(self.levels))])).select(row).distinct().withColumn(out, F.lit(True))
        return rows.join(hit, row, "left").withColumn(out, F.coalesce(out, F.lit(False))).drop(row)

    @staticmethod
    def _walk(key: Column, levels: list[Column]) -> Column:
        """Listed if the first level that misses the key is odd, or if no level does and their number is odd."""
        answer = F.lit(len(levels) % 2 == 1)
        for k in reversed(range(len(levels))):
            answer = F.when(~holds(key, k, levels[k]), F.lit(k % 2 == 1)).otherwise(answer)
        return answer


def filter_urls(pages: DataFrame, blocked: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``; blocked(key): domains."""
    keys, hit = fresh(pages, "keys", "listed")
    df = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn(keys, domains(F.col("host")))
    listed = blocked.select(F.translate("key", UPPER, LOWER).alias("key"))
    judged = Cascade(df.select(F.explode(keys).alias("key")), listed).flag(df, keys, hit)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col(hit), "block").otherwise("allow"))}).drop(keys, hit)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct()
    blocked = spark.createDataFrame([(k,) for k in BLOCKED], "key string").union(hosts.where((F.col("key") != "") & F.md5("key").startswith(LISTED_MD5)))
    return filter_urls(pages, blocked).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN list_has_any(list_transform(generate_series(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')), b) THEN 'block' ELSE 'allow' END AS verdict
FROM r, (SELECT list_concat(%LIST%, coalesce(list(DISTINCT host) FILTER (host <> '' AND md5(host) LIKE '0%'), [])) AS b FROM u)
""".replace("%LIST%", repr(list(BLOCKED)))
