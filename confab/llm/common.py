"""Helpers that the text operators share: input loading, column hygiene, checkpoints and Arrow row maps.

Conventions of every operator in this package:

* an operator reads only the columns it is told to read; any further input column passes through untouched;
* a result column replaces an input column of the same name (pass ``prefix`` to keep both);
* a null text counts as the empty text unless the operator's docstring says otherwise.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that one step of an Arrow map handles at a time; numpy temporaries are some 40 times that.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where it is unset and Spark runs on this one machine (tests), a local one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + os.path.join(tempfile.gettempdir(), f"confab-checkpoints-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there, and no executor holds it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with: it does so when the driver has collected them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns to the machine what a task has freed: Python workers live on, and would hold it while other tasks need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that a result column of the same name replaces."""
    lower = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in lower])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in have:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a slice holds at most ``most`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and where each begins (one entry more than texts). Nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def add_columns(df: DataFrame, text_col: str, fields: list[T.StructField], work: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], most: int = SLICE_BYTES) -> DataFrame:
    """``df`` with further columns that ``work()`` makes from slices of bounded size; rows stay in their partitions.

    ``work`` is called once per task and returns the function that maps a slice to one Arrow array per field.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    base = without(df, [f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            for part in slices(batch, text_col, most):
                made = [a.cast(f.type) for a, f in zip(step(part), list(arrow)[part.num_columns :], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=arrow.names)
        give_back()

    return base.mapInArrow(run, schema)
