"""What the operators of this subpackage share: stage tables, folds, word patterns and input checks."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \x09-\x0D. Everything else belongs to a word.
SPACES = " \t\n\x0b\f\r"
SPACE_RE = "[ \\t-\\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for stage tables: spark.checkpoint.dir, or a local one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="timeloom-stages-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives the loss of any executor. ``by``: a column that parts its files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """A stage table goes when the driver ends."""
    fs, made = file_system(spark, path)
    fs.deleteOnExit(made)


def unstage(df: DataFrame, part: str) -> None:
    """Delete a part (such as ``kind=1``) of a stage table that nothing reads any more."""
    for folder in {f.rsplit(f"/{part}/", 1)[0] for f in df.inputFiles() if f"/{part}/" in f}:
        fs, made = file_system(df.sparkSession, f"{folder}/{part}")
        fs.delete(made, True)


def free_shuffles(spark: SparkSession) -> None:
    """What finished jobs have shuffled leaves the disks once nothing refers to it: collect garbage here and in the JVM, where the first round only enqueues what the second frees."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, as an array; none for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


#: The ASCII capitals and their small forms.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash() -> Column:
    """What tells rows of documents apart where doc_id is null or repeated: 64 bits of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes a plan reads, without a job; where it has none, the bytes of the column ``text``."""
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return guess if guess < 1 << 56 else int(df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
