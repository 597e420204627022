"""Configurations, rule tables, reference maps, caches, sound as rows, and stores that are updated in place.

Documents are read and written by Spark and its file system, so any store that Spark reaches will do. What is written appears at once: it is written beside its place and
moved there. A missing or unreadable document gives no rows where that is said, and an error elsewhere.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_FRAMES = 65_536


def file_system(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def exists(spark: SparkSession, path: str) -> bool:
    fs, made = file_system(spark, path)
    return fs.exists(made)


def remove(spark: SparkSession, path: str) -> bool:
    fs, made = file_system(spark, path)
    return fs.delete(made, True)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """``source`` takes the place of ``target``."""
    fs, made = file_system(spark, target)
    fs.delete(made, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), made)


def read_document(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """One file with a text, whole or not at all."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, made = file_system(spark, beside)
    out = fs.create(made, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    moved(spark, beside, path)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A JSON document with sorted keys."""
    write_document(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n")


def write_json_lines(df: DataFrame, path: str) -> None:
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.json(beside)
    moved(df.sparkSession, beside, path)


def set_path(config: dict, path: str, value: object) -> dict:
    """A nested setting by its dotted path; levels that are missing are made."""
    *above, last = path.split(".")
    at = config
    for name in above:
        at = at.setdefault(name, {})
        if not isinstance(at, dict):
            raise ValueError(f"{path}: {name} holds a value")
    at[last] = value
    return config


def read_config(spark: SparkSession, path: str, corrections: str | None = None) -> dict:
    """A nested configuration (JSON, or YAML where a reader is installed), with a document of corrections by dotted paths laid over it."""

    def parsed(text: str | None) -> dict:
        if not text:
            return {}
        try:
            return json.loads(text)
        except ValueError:
            try:
                import yaml
            except ImportError as e:
                raise ValueError("not JSON, and no YAML reader is installed") from e
            return yaml.safe_load(io.StringIO(text)) or {}

    config = parsed(read_document(spark, path))
    for name, value in parsed(read_document(spark, corrections) if corrections else None).items():
        set_path(config, name, value)
    return config


def rule_table(spark: SparkSession, config: dict) -> DataFrame:
    """Rules of a configuration as rows (kind, pos, source, target, required, forbidden): replacements, patterns and guarded replacements."""
    rows = [("replacement", i, a, b, [], []) for i, (a, b) in enumerate((config.get("replacements") or {}).items())]
    rows += [("pattern", i, p, None, [], []) for i, p in enumerate(config.get("patterns") or [])]
    rows += [("guarded", i, r.get("source"), r.get("target"), r.get("required") or [], r.get("forbidden") or []) for i, r in enumerate(config.get("guarded") or [])]
    return spark.createDataFrame(rows, "kind string, pos int, source string, target string, required array<string>, forbidden array<string>")


def inside_path(path: Column) -> Column:
    """Whether a relative path stays in its folder: no root, no drive, and no step above the top."""
    steps = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: ~s.isin("", "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")), lambda a, s: F.struct((a["d"] + F.when(s == "..", -1).otherwise(1)).alias("d"), F.least(a["least"], a["d"] + F.when(s == "..", -1).otherwise(1)).alias("least")))
    return F.coalesce(~F.regexp_like(path, F.lit("^(/|\\\\|[A-Za-z]:)")) & (depth["least"] >= 0), F.lit(False))


def read_reference_map(spark: SparkSession, path: str, root: str) -> DataFrame:
    """A JSON map of style to reference as rows (style, prompt_lang, prompt_text, path, inside): paths are resolved in ``root``, and flagged if they lead out of it."""
    entry = "struct<prompt_lang:string,prompt_text:string,ref_audio_path:string>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("style", "r"))
    rel = F.col("r.ref_audio_path")
    return raw.select("style", "r.prompt_lang", "r.prompt_text", F.concat(F.lit(root.rstrip("/") + "/"), rel).alias("path"), inside_path(rel).alias("inside"))


def read_cache(spark: SparkSession, path: str, signature: str, row: str) -> DataFrame:
    """Rows of a cached JSON document {signature, rows}; none if it is missing, unreadable or was made for another signature."""
    none = spark.createDataFrame([], row)
    if not exists(spark, path):
        return none
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"signature string, rows array<struct<{none.schema.simpleString()[7:-1]}>>").alias("d"))
    return raw.where(F.col("d.signature") == signature).select(F.explode("d.rows").alias("r")).select("r.*")


def write_cache(spark: SparkSession, path: str, signature: str, rows: list[dict]) -> None:
    write_json(spark, path, {"signature": signature, "rows": rows})


def pcm_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) of WAV files to (path, rate, channels, block, at, samples): blocks of frames, samples interleaved as 32-bit floats; NaN and infinity become 0."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_buffer()
            view, at, kind, chunk = memoryview(data), 12, None, None
            while at + 8 <= len(view):
                name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
                if name == b"fmt ":
                    kind = struct.unpack_from("<HHIIHH", view, at + 8)
                elif name == b"data":
                    chunk = view[at + 8 : at + 8 + size]
                    break
                at += 8 + size + size % 2
            if kind is None or chunk is None or kind[1] == 0:
                continue
            form, channels, rate, _, _, bits = kind
            if form == 3:
                samples = np.frombuffer(chunk[: len(chunk) // 4 * 4], "<f4").astype(np.float32)
            elif bits == 16:
                samples = np.frombuffer(chunk[: len(chunk) // 2 * 2], "<i2").astype(np.float32) / 32768
            else:
                continue
            samples = np.nan_to_num(samples[: len(samples) // channels * channels], nan=0.0, posinf=0.0, neginf=0.0)
            step = BLOCK_FRAMES * channels
            for k in range(0, max(1, -(-len(samples) // step))):
                part = samples[k * step : (k + 1) * step]
                yield pa.RecordBatch.from_pydict({"path": [path], "rate": pa.array([rate], pa.int32()), "channels": pa.array([channels], pa.int32()), "block": pa.array([k], pa.int32()), "at": pa.array([k * BLOCK_FRAMES], pa.int64()), "samples": pa.array([part], pa.list_(pa.float32()))})


def read_pcm(spark: SparkSession, path: str) -> DataFrame:
    """Sound files as rows of blocks of ``BLOCK_FRAMES`` frames, in bounded memory for each block; files that are no 16-bit or float WAV give no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(pcm_blocks, "path string, rate int, channels int, block int, at long, samples array<float>")


def whole_pcm(blocks: DataFrame) -> DataFrame:
    """One row a file: all its samples, in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "samples"))), lambda b: b["samples"])
    return blocks.groupBy("path").agg(F.first("rate").alias("rate"), F.first("channels").alias("channels"), F.flatten(parts).alias("samples"))


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = "|") -> DataFrame:
    """Lines of fields without quotes or header; lines with another number of fields give no row."""
    n = len(spark.createDataFrame([], schema).columns)
    parts = spark.read.text(path).select(F.split("value", "[" + separator + "]", -1).alias("p")).where(F.size("p") == n)
    names = spark.createDataFrame([], schema).schema
    return parts.select(*[F.get("p", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(names)])


def or_whole(df: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Segments (key, start, end), and one row over the whole file for each of files(key, duration) that has none."""
    lone = files.join(df.select(key), key, "left_anti").select(key, F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    return df.select(key, "start", "end").unionByName(lone)


def upsert(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows take the place of those with their key, or are added. Of several new rows with one key any may win: keys are to be unique."""
    return df.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def fill_missing(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Only null or empty fields are filled."""
    return df.withColumns({c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", v).otherwise(F.col(c)) for c, v in values.items()})


def save_candidates(rows: DataFrame, path: str) -> None:
    """Candidates (segment_id, backend, candidate_id, ...) are put into their partitions, replacing those of the same id; other partitions are not touched."""
    spark = rows.sparkSession
    if exists(spark, path):
        touched = rows.select("segment_id", "backend").distinct()
        old = spark.read.parquet(path).join(touched, ["segment_id", "backend"], "left_semi")
        rows = upsert(old, rows, ["segment_id", "backend", "candidate_id"])
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    rows.write.partitionBy("segment_id", "backend").parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment_id", "backend").parquet(path)
    remove(spark, beside)


def drop_segment(spark: SparkSession, path: str, segment_id: str) -> bool:
    """All candidates of a segment; whether there were any."""
    return remove(spark, f"{path.rstrip('/')}/segment_id={segment_id}") if exists(spark, f"{path.rstrip('/')}/segment_id={segment_id}") else False


def save_selected(rows: DataFrame, path: str) -> None:
    """One selected row a segment; segments that are not among the rows keep theirs."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment_id").parquet(path)


def write_list(df: DataFrame, path: str, columns: list[str], separator: str = "|") -> None:
    """Lines of fields joined by a separator, which no field may hold."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), f"[{separator}\\r\\n]", " ") for c in columns]
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.select(F.concat_ws(separator, *clean).alias("value")).write.text(beside)
    moved(df.sparkSession, beside, path)


def write_dataset(rows: DataFrame, rejects: DataFrame, path: str, seconds: str) -> dict:
    """Rows, rejects and a summary side by side; returns the summary."""
    write_json_lines(rows, f"{path}/rows")
    write_json_lines(rejects, f"{path}/rejects")
    spark = rows.sparkSession
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("s")).first()
    reasons = {r.reason: r.n for r in rejects.select(F.explode("reasons").alias("r")).groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n")).collect()}  # one row a kind of reason
    summary = {"rows": n.n, "seconds": n.s, "rejects": reasons}
    write_json(spark, f"{path}/summary.json", summary)
    return summary


def with_hits(rows: DataFrame, matches: DataFrame, ident: str) -> DataFrame:
    """Rows with the distinct replacement hits (source, target, count) of the items that they match (see speakers.matching_items), in order of their source."""
    hits = matches.select(ident, F.explode("hits").alias("h")).where(F.col("h.source") != "").groupBy(ident).agg(F.array_sort(F.collect_set("h")).alias("hits"))
    return rows.join(hits, ident, "left")


def write_catalog(spark: SparkSession, path: str, entries: dict[str, dict]) -> None:
    """A map of speakers."""
    write_json(spark, path, {"speakers": entries})


def read_catalog(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """A map of speakers as rows: speaker and the fields of ``entry``, a schema. A document that is missing or unreadable gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"speaker string, {entry}")
    fields = spark.createDataFrame([], entry).schema.simpleString()
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"speakers map<string,{fields}>").alias("d"))
    return raw.select(F.explode("d.speakers").alias("speaker", "e")).select("speaker", "e.*")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """The sha-256 of each file below a path, read as a stream of rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def run_closure(nodes: list[tuple[str, Callable[[DataFrame], DataFrame]]], targets: list[str], df: DataFrame, ident: str, ids: list, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The requested nodes, in order, over some rows only; the others pass as they are. The rows that ran are verified."""
    some = F.col(ident).isin(ids)
    ran = reduce(lambda d, n: n[1](d) if n[0] in targets else d, nodes, df.where(some))
    return verify(ran).unionByName(df.where(~some | F.col(ident).isNull()), allowMissingColumns=True)
