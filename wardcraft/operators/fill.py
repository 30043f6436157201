"""Fill down: the last value before each row of its key, by a scan over sorted ranges, so that a key may hold any part of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcraft.plans.shared import materialise


def _scan(key: str, value: str):
    """Sorted rows -> the same with _filled, the last value of the key up to the row within this task, and _open, true in the task's first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = ...
        carried = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.empty(n, object)
            keys[:] = batch.column(key).to_pylist()
            first = keys[0] if first is ... else first
            starts = np.flatnonzero(np.r_[keys[0] != last, keys[1:] != keys[:-1]])
            place, values = np.arange(n), batch.column(value)
            start = np.full(n, -1)
            start[starts] = starts
            start = np.maximum.accumulate(start)  # -1: the key goes on from the batch before
            seen = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), place, -1))
            own = (seen >= 0) & (seen >= start)
            filled = values.take(pa.array(np.where(own, seen, 0), mask=~own))
            if carried is not None:
                filled = pc.if_else(pa.array((start < 0) & ~own), carried, filled)
            last, carried = keys[-1], filled[-1] if filled[-1].is_valid else None
            yield pa.RecordBatch.from_arrays([*batch.columns, filled, pa.array(keys == first)], [*batch.schema.names, "_filled", "_open"])

    return run


def filled(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """rows with `name`: the value of the last row of the key up to this one, in this order, that has one; null where there is none.

    Rows are sorted in ranges of key and order, each range is scanned once, and what a task's last key ends with goes on in the next tasks:
    a row per task comes to the driver. A null key is a key; rows that tie in the order may stand either way.
    """
    columns = rows.columns
    ranged = rows.repartitionByRange(key, order).sortWithinPartitions(key, order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_k"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    scanned = ranged.mapInArrow(_scan(key, value), f"{kinds}, _filled {rows.schema[value].dataType.simpleString()}, _open boolean")
    scanned = materialise(rows.sparkSession, scanned, "filled")
    end, start = F.max_by(F.struct(F.col(key).alias("key"), F.col("_filled").alias("value")), "_k"), F.min_by(F.struct(F.col(key).alias("key")), "_k")
    tasks = scanned.groupBy("_p").agg(end.alias("e"), start.alias("s")).collect()  # a row per task
    carried, held = [], (..., None)
    for t in sorted(tasks, key=lambda t: t["_p"]):
        if t.s.key == held[0] and held[1] is not None:
            carried += [F.lit(t["_p"]), F.lit(held[1]).cast(rows.schema[value].dataType)]
        held = (t.e.key, t.e.value if t.e.value is not None or t.e.key != held[0] else held[1])
    before = F.when(F.col("_open"), F.element_at(F.create_map(*carried), F.col("_p"))) if carried else F.lit(None)
    return scanned.select(*columns, F.coalesce("_filled", before).alias(name))
