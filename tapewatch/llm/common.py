"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.operators.lineage import checkpoint_folder

#: Rows and bytes of a table that may be sent to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def new_folder(df: DataFrame) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{checkpoint_folder(df)}/llm-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back; lost executors cost nothing that was written."""
    folder = new_folder(df)
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """Run ``make()`` once per task and its result on every Arrow batch of the task. What Arrow keeps for later goes back at the task's end, as workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)
        batch = step = None
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if ``df`` is found to have at most ``rows`` rows and ``size`` bytes; else a shuffled join is left to Spark."""
    length = F.lit(0)
    for c in df.columns:
        length = length + F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(length)).head()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def own_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batch in parts, so that what is made from long texts leaves the worker soon. An empty batch is one part."""
    for k in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(k, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, and no other letter."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
