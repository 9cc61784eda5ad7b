"""Bounded Arrow batches, a cache that lives as long as a Python worker, and written intermediate tables."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lapak.session import checkpoint_dir

MAX_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = MAX_BYTES, max_rows: int = 1 << 20
           ) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``max_rows`` rows whose ``column`` holds at most ``max_bytes``, or one longer row."""
    cells = batch.column(column)
    listed = pa.types.is_list(cells.type)  # of numbers of at most eight bytes
    lengths = pc.multiply(pc.list_value_length(cells), 8) if listed else pc.binary_length(cells)
    sizes = pc.fill_null(lengths, 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and (held + size > max_bytes or at - start >= max_rows):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object made once per Python worker process and used again by its later tasks."""
    holder = sys.modules.setdefault("_lapak_worker_cache", types.ModuleType("_lapak_worker_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` from a table below the shared checkpoint folder: computed once, kept when executors are lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lapak-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
