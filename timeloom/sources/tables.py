"""Reading and writing: tables, manifests of segments, JSON with faults, files, and partitioned candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.text import natural_key

SCHEMA_VERSION = 1
WORD = "struct<start: double, end: double, text: string, confidence: double>"
SEGMENT = "struct<id: string, start: double, end: double, duration: double, speaker_id: string, status: string, text: string, analysis: string>"
CHUNK = f"start double, end double, text string, language string, confidence double, words array<{WORD}>"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Segments of whole-document JSON manifests, one row each with its position. Other versions are refused by an assertion in the plan."""
    raw = spark.read.schema(f"schema_version int, project_id string, segments array<{SEGMENT}>").option("multiLine", True).json(path)
    checked = raw.where(F.assert_true(F.coalesce(F.col("schema_version"), F.lit(0)) == SCHEMA_VERSION, F.lit("unknown schema_version")).isNull())
    return checked.select("project_id", F.posexplode("segments").alias("pos", "s")).select("project_id", "pos", "s.*")


def check_segments(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected ones with their reasons: times must be in order and agree with the duration within 0.01 s."""
    from timeloom.operators.reasons import gate

    judged = gate(df, (F.col("end").isNull() | F.col("start").isNull(), "missing_time"), (F.col("end") <= F.col("start"), "not_positive"), (F.abs(F.col("end") - F.col("start") - F.col("duration")) > 0.01, "duration_mismatch"))
    return judged.where("accepted").drop("accepted", "reasons"), judged.where("not accepted").drop("accepted")


def write_manifest(df: DataFrame, path: str) -> None:
    """One JSON document for each project; a project's segments must fit one row."""
    fields = [c for c in df.columns if c not in ("project_id", "pos")]
    made = df.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("s")))), lambda x: x["s"]).alias("segments"))
    made.select(F.lit(SCHEMA_VERSION).alias("schema_version"), "project_id", "segments").write.mode("overwrite").json(path)


def read_loose_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; what cannot be read gives no row."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where(F.col("_corrupt").isNull()).drop("_corrupt")


def list_files(spark: SparkSession, path: str, extensions: list[str], excluded: list[str] = (), included: list[str] = (), limit: int | None = None) -> DataFrame:
    """Files below a folder by extension; hidden ones and those with an excluded part in their path, or without any included one, are out. Contents are not read.

    With a limit the first in natural order (digit runs as numbers) are given.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    good = F.regexp_like(F.lower(name), F.lit("\\.(" + "|".join(extensions) + ")$")) & ~name.startswith(".")
    for part in excluded:
        good = good & ~F.lower("path").contains(part.lower())
    if included:
        good = good & reduce(lambda a, b: a | b, [F.lower("path").contains(part.lower()) for part in included])
    found = df.where(good)
    return found if limit is None else found.orderBy(natural_key(F.col("path"))).limit(limit)


def write_candidates(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("segment_id", "backend").parquet(path)


def read_candidates(spark: SparkSession, path: str, segment_id: str | None = None) -> DataFrame:
    """Candidates of a segment (partition pruning), or all of them."""
    df = spark.read.parquet(path)
    return df if segment_id is None else df.where(F.col("segment_id") == segment_id)


def append_audit(df: DataFrame, path: str) -> None:
    """Audit rows are only ever appended."""
    df.write.mode("append").json(path)
