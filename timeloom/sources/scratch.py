"""Tables that a job writes for itself, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read again: lineage is cut, and no executor's loss matters. Where that is unset (tests) a
    temporary folder is set. The table goes when the driver ends."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="timeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(made)
    return spark.read.schema(df.schema).parquet(path)
