"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two(docs: DataFrame) -> DataFrame:
    """doc_id and text only, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of `rows`, so that only a part of it stands in Python objects at a time."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def groups(batch: pa.RecordBatch, limit: int = 1 << 20, column: str = "text", rows: int = 1000) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in runs of about `limit` bytes, with each run's place; null counts as empty."""
    first = 0
    for part in slices(batch, rows):
        found = texts(part, column)
        at = size = 0
        for k, x in enumerate(found):
            size += len(x)
            if size >= limit or k == len(found) - 1:
                yield first + at, [y.decode() for y in found[at : k + 1]]
                at, size = k + 1, 0
        first += part.num_rows


def as_batch(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_kept: list = ["nothing yet", None]
#: Where the C library can give freed memory back, do so between operators.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def only(owner, make: Callable = lambda: None):
    """What `make` gives, kept in this worker process until another owner comes: a reused worker holds the caches of one operator at a time."""
    if _kept[0] != owner:
        _kept[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _TRIM:
            _TRIM(0)
        _kept[:] = [owner, make()]
    return _kept[1]


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow out of one for a batch, for operators without caches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(None)
        for batch in batches:
            for part in slices(batch):
                yield f(part)

    return run


class Cache(dict):
    """A dict of two generations: at `limit` new entries the older ones go, so that memory stays bounded. Keys above `longest` aren't held."""

    def __init__(self, make: Callable, limit: int, longest: int = sys.maxsize):
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def table_of(chars: str) -> np.ndarray:
    """256 booleans: which bytes are in the set."""
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1"))] = True
    return out
