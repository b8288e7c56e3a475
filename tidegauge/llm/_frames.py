"""Helpers for frames: columns made by Arrow functions, and work that is written to the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T

#: Folder for checkpoints where a session in local mode names none, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


#: Bytes of the first input column that are worked on at once; a longer value makes a part of its own.
PART_BYTES = 4 << 20


def trim() -> None:
    """Give memory that is free back to the machine: workers live on and would keep their largest."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch, cut by the bytes of a column if it is of texts."""
    c = batch.column(batch.schema.get_field_index(column))
    if not (pa.types.is_string(c.type) or pa.types.is_large_string(c.type)) or c.nbytes <= PART_BYTES:
        yield batch
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PART_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def add_columns(df: DataFrame, inputs: list[str], fields: str, make: Callable[[], Callable], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with new columns; a new column replaces one of the same name.

    fields: DDL of the new columns. make() is called once in each task and returns a function from the
    input columns (Arrow arrays of one batch) to the new columns (Arrow arrays or lists).
    """
    new = T._parse_datatype_string(fields)
    keep = [f for f in df.schema.fields if f.name not in new.fieldNames() and f.name not in drop]
    names = [f.name for f in keep]
    used = df.select(*[f"`{n}`" for n in dict.fromkeys([*names, *inputs])])

    def run(batches):
        f = make()
        for batch in batches:
            for b in parts(batch, inputs[0]):
                made = f(*[b.column(b.schema.get_field_index(n)) for n in inputs])
                own = [b.column(b.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[*names, *new.fieldNames()])
        trim()

    return used.mapInArrow(run, T.StructType([*keep, *new.fields]))


def shared(spark: SparkSession) -> SparkSession:
    """See to it that there is a checkpoint folder: the cluster's own in spark.checkpoint.dir; a local one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return spark


def written(df: DataFrame) -> DataFrame:
    """df computed now and kept in the shared folder, so that no later step repeats it or loses it with an executor."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew for whatever comes next.

    For an aggregate that is joined on its own keys: a join of it as it lies would keep all rows of a hot key in one
    task; with an exchange on either side Spark splits such a key.
    """
    return df.hint("rebalance")
