"""Which texts contain which short texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RUN = 3  # words of an item that are looked up
BLOCK_CHARS = 64 << 20  # of items that travel to all tasks at once


def searched(shared, schema: T.StructType):
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run, short = shared.value
        for batch in batches:
            docs, items = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                words = text.split()
                near = {i: item for a in zip(*(words[n:] for n in range(RUN))) if a in by_run for i, item in by_run[a]}
                for i, item in [*near.items(), *short]:
                    if item in text:
                        docs.append(batch.column(0)[k].as_py())
                        items.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(docs, types[0]), pa.array(items, types[1])], names=schema.names)

    return run


def contained(docs: DataFrame, ident: str, items: DataFrame, item: str, text: str = "text") -> DataFrame:
    """(ident, item) of every text that contains an item's text, wherever it begins and ends. Null texts and empty items match nothing.

    The words of an item but the first and the last stand in a text as they are; three of them are looked up, and containment is tested where they are met. Items with fewer such words
    are tested everywhere. Items travel to the texts, in blocks of bounded size; texts are read where they are.
    """
    schema = T.StructType([T.StructField(ident, docs.schema[ident].dataType), T.StructField(item, items.schema[item].dataType)])
    rows = docs.select(ident, text)
    out, by_run, short, size = None, {}, [], 0

    def search() -> DataFrame:
        return rows.mapInArrow(searched(docs.sparkSession.sparkContext.broadcast((by_run, short)), schema), schema)

    for r in items.select(item, F.col(text).alias("t")).where("t <> ''").toLocalIterator():
        words = r.t.split()[1:-1]
        if len(words) >= RUN:
            middle = (len(words) - RUN) // 2
            by_run.setdefault(tuple(words[middle : middle + RUN]), []).append((r[0], r.t))
        else:
            short.append((r[0], r.t))
        size += len(r.t)
        if size >= BLOCK_CHARS:
            out = search() if out is None else out.unionByName(search())
            by_run, short, size = {}, [], 0
    if size:
        out = search() if out is None else out.unionByName(search())
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
