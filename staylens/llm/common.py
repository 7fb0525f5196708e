"""Helpers shared by the operators of this subpackage: table access, Arrow batch slicing, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.session import ensure_checkpoint_dir

# An Arrow batch is worked on in slices of at most so many rows and bytes of text (one text may be longer).
SLICE_ROWS = 4000
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read by Spark alone (the folder may be in a store only Spark can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; further columns of any name are left out."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = SLICE_ROWS,
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices (views, not copies) of bounded rows and bytes, so that few texts are Python
    objects at once. A text that is longer than ``size`` makes a slice of its own."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype="i8")
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # the worker may sit idle beside others after this task


def materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unsigned_hex(c: Column) -> Column:
    """A long's 64 bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table as Parquet to the shared folder of ``spark.checkpoint.dir`` and read it again: its rows then stay as
    they are whatever executor is lost, and later passes read the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
