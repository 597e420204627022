"""Quality rules: a threshold table compiled into one projection of ratios over every whole text.

``RULES`` lists (ratio, least, most); ``apply_rules`` turns it into Spark expressions over counts that one projection
takes from the text. No user function runs and nothing is shuffled: a row is judged where it is read.

Defined cases. A null text counts as empty: every count is 0, so it fails the base rule. Ratios over nothing are 0. Texts are
judged whole at any length; a text of n words costs n log n. Repeated rows are judged separately, and columns beside the
text pass through unless they carry the name of an output (then the output replaces them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.common import table, words

#: Frequent function words of the languages handled.
STOP_WORDS = (
    "the be to of and that have with is in it for was on are as by he at from this or an which not but they "
    "de la le et les des en un une du que qui dans pour par sur il au est pas "
    "der die und den von zu das mit sich auf für ein eine im dem nicht ist "
    "el los las del por con para una su al lo como más se no y"
).split()

#: (ratio, least, most): a text is kept if every ratio lies within its bounds. None: no bound.
RULES = (
    ("word_length", 2.0, 12.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("capital_ratio", None, 0.5),
    ("pipe_ratio", None, 0.2),
    ("exclaim_ratio", None, 0.3),
    ("word_variety", 0.05, None),
)


def n_matches(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in the character class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def with_repeat_words(df: DataFrame, ws: str, out: str) -> DataFrame:
    """Adds ``out``: words in windows of three words that occur twice or more; every word once, the first occurrence included.

    Windows are hashed to 64 bits and sorted with their positions; equal neighbours are repeats, and the covered words
    follow from the gaps between the repeats' positions. Every array is a column of its own, so that no lambda makes it anew.
    """
    n = F.size(ws)
    gram = lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i"))
    df = df.withColumn("_g", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), gram)))
    hashes = F.transform("_g", lambda g: g["h"])
    df = df.withColumn("_o", F.when(F.size(F.array_distinct(hashes)) < F.size("_g"), F.sort_array("_g")))
    same = lambda a, b: F.coalesce(F.get("_o", a)["h"] == F.get("_o", b)["h"], F.lit(False))
    df = df.withColumn("_f", F.sort_array(F.transform(F.filter("_o", lambda g, k: same(k, k + 1) | same(k - 1, k)), lambda g: g["i"])))
    none = F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_f", none, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("_g", "_o", "_f")


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds what the ratios need; the word array is made once and then dropped."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit("[^ \\t-\\r]")))
    df = df.withColumns({"_w": words(F.col(text)), "_l": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": (F.length(t) - F.length(F.regexp_replace(t, "[^ \\t-\\r]+", ""))).cast("long"),
            "n_symbols": n_matches(t, "#*$%&|<>"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_distinct_words": F.size(F.array_distinct("_w")).cast("long"),
            "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_letters": n_matches(t, "\\p{L}"),
            "n_capitals": n_matches(t, "\\p{Lu}"),
            "n_pipes": F.size(F.filter("_w", lambda w: w == "|")).cast("long"),
            "n_exclaims": n_matches(t, "!"),
        }
    )
    return with_repeat_words(df, "_w", "n_repeat_words").drop("_w", "_l")


def ratios() -> dict[str, Column]:
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "word_length": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "stop_word_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "capital_ratio": over("n_capitals", "n_letters"),
        "pipe_ratio": over("n_pipes", "n_words"),
        "exclaim_ratio": over("n_exclaims", "n_words"),
        "word_variety": over("n_distinct_words", "n_words"),
    }


def apply_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Adds the counts, base_failed, failed_rules (array of names) and kept."""
    counted, have = with_counts(df, text), ratios()
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = []
    for name, least, most in rules:
        out = (have[name] < least) if least is not None else F.lit(False)
        out = out | (have[name] > most) if most is not None else out
        broken.append(F.when(out, F.lit(name)))
    return counted.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*broken))}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: DuckDB's form of op2. The rules are spelled out once more, so that the two can disagree.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c >= 2) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines,
    len(list_distinct(w)) AS n_kinds, len(list_filter(w, lambda x: list_contains(string_split('%STOP%', ' '), lower(x)))) AS n_stop,
    length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_capitals,
    len(list_filter(w, lambda x: x = '|')) AS n_pipes, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims
  FROM d LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_chars / nullif(n_words, 0), 0) BETWEEN 2 AND 12 AND coalesce(n_symbols / nullif(n_words, 0), 0) <= 0.1
  AND coalesce(n_stop / nullif(n_words, 0), 0) >= 0.02 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5
  AND coalesce(n_capitals / nullif(n_letters, 0), 0) <= 0.5 AND coalesce(n_pipes / nullif(n_words, 0), 0) <= 0.2
  AND coalesce(n_exclaims / nullif(n_words, 0), 0) <= 0.3 AND coalesce(n_kinds / nullif(n_words, 0), 0) >= 0.05 AS kept
FROM b
""".replace("%STOP%", " ".join(STOP_WORDS))
