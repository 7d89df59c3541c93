"""Shared helpers: durable intermediates, Arrow batch handling, and the tokenizer files' place."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from semilog.storage import scratch
from semilog.storage import written as materialise

#: Rows and bytes that a Python stage works on at once; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 1024, 2_000_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, asked of the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def with_arrow(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[..., list]) -> DataFrame:
    """``df`` and the columns that ``make`` computes from the columns ``inputs``, batch by batch.

    ``make`` gets one Arrow array per input and gives one Arrow array per field. Columns of ``df`` that
    have a new column's name are replaced.
    """
    names = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    at = {c: i for i, c in enumerate(df.columns)}
    keep_at, in_at = [at[c] for c in keep], [at[c] for c in inputs]
    out_names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                made = make(*[batch.column(i) for i in in_at])
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep_at] + made, names=out_names)
        give_back()

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What a Python worker remembers from task to task, by operator; only the operator that runs keeps its own.
REMEMBERED: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """The cache of an operator; those of others are forgotten."""
    for name, cache in REMEMBERED.items():
        if name != owner:
            cache.clear()
    return REMEMBERED.setdefault(owner, {})


def give_back() -> None:
    """Returns memory that allocators hold but don't use, so idle workers stay small beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that are bounded in rows and bytes."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if i > start and (i - start >= SLICE_ROWS or held + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(start)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


__all__ = ["exists", "give_back", "materialise", "remembered", "scratch", "slices", "texts_of", "tokenizer_file", "unused", "with_arrow"]


def tokenizer_file(name: str) -> str:
    """A public vocabulary's place on the machine that asks; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
