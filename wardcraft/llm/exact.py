"""Exact duplicates by counting quotient filters.

Each partition puts the 64-bit fingerprints of its texts into counting quotient filters, one for each range of the
highest bits. A filter keeps the quotient of a fingerprint as a place and its remainder in a slot, sorted, so it
gives its fingerprints back in order, and filters of a range merge without loss by merging sorted remainders and
adding counts. Fingerprints with a count above one send their texts to byte verification: texts are grouped by
their bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.text import as_batch, per_batch, table, texts, two
from wardcraft.plans.shared import materialise

#: Fingerprints that a merged filter holds, on average.
RANGE_ROWS = 1 << 18


class CountingQuotientFilter:
    """Sorted fingerprints with counts. `bits`: of a fingerprint; the highest `q` of them choose its home slot."""

    def __init__(self, bits: int, q: int, occupied: np.ndarray, run_end: np.ndarray, remainder: np.ndarray, count: np.ndarray):
        self.bits, self.q, self.occupied, self.run_end, self.remainder, self.count = bits, q, occupied, run_end, remainder, count

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From distinct sorted uint64 fingerprints below 2**bits and their counts."""
        n = len(fingerprints)
        q = min(bits - 1, max(1, int(np.ceil(np.log2(max(1, n) / 0.9)))))
        quotient = (fingerprints >> np.uint64(bits - q)).astype(np.int64)
        # linear probing of sorted rows: each goes home, or to the slot after the one before
        slot = np.maximum.accumulate(quotient - np.arange(n)) + np.arange(n) if n else np.zeros(0, np.int64)
        size = max(1 << q, int(slot[-1]) + 1 if n else 0)
        occupied, run_end = np.zeros(1 << q, bool), np.zeros(size, bool)
        remainder, count = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        occupied[quotient] = True
        run_end[slot[np.r_[quotient[1:] != quotient[:-1], True]] if n else slot] = True
        remainder[slot], count[slot] = fingerprints & np.uint64((1 << (bits - q)) - 1), counts
        return cls(bits, q, occupied, run_end, remainder, count)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints in order, counts): the k-th occupied quotient owns the k-th run."""
        quotient, end = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end)
        if not len(end):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        start = np.maximum(quotient, np.r_[0, end[:-1] + 1])
        size = end - start + 1
        slot = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return np.repeat(quotient, size).astype(np.uint64) << np.uint64(self.bits - self.q) | self.remainder[slot], self.count[slot]

    def to_bytes(self) -> bytes:
        """Only used slots are written; their remainders in as many bytes as they need."""
        used, width = np.flatnonzero(self.count), -(-(self.bits - self.q) // 8)
        many = np.flatnonzero(self.count[used] > 1)
        return b"".join([
            struct.pack("<BBBQQQ", self.bits, self.q, width, len(self.run_end), len(used), len(many)),
            np.packbits(self.occupied).tobytes(),
            np.packbits(self.run_end).tobytes(),
            np.packbits(self.count > 0).tobytes(),
            self.remainder[used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(),
            many.astype("<u8").tobytes(),
            self.count[used][many].astype("<i8").tobytes(),
        ])

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, q, width, size, used, many = struct.unpack_from("<BBBQQQ", raw)
        at = struct.calcsize("<BBBQQQ")

        def bitmap(n: int) -> np.ndarray:
            nonlocal at
            at += -(-n // 8)
            return np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at - -(-n // 8)))[:n].astype(bool)

        occupied, run_end, full = bitmap(1 << q), bitmap(size), bitmap(size)
        packed = np.zeros((used, 8), np.uint8)
        packed[:, :width] = np.frombuffer(raw, np.uint8, used * width, at).reshape(-1, width)
        at += used * width
        where = np.frombuffer(raw, "<u8", many, at).astype(np.int64)
        counts = np.ones(used, np.int64)
        counts[where] = np.frombuffer(raw, "<i8", many, at + 8 * many)
        remainder, count = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        remainder[full], count[full] = packed.view("<u8").ravel(), counts
        return cls(bits, q, occupied, run_end, remainder, count)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: the same filter as from all fingerprints at once."""
        parts = [f.items() for f in filters]
        fps, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(fps, kind="stable")  # the runs are sorted: this merges them
        return cls.of(*summed(fps[order], counts[order]), filters[0].bits)


def summed(fps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted fps with the sums of their counts."""
    first = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]]) if len(fps) else np.zeros(0, np.int64)
    return fps[first], np.add.reduceat(counts, first) if len(first) else counts


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [hashlib.sha256(x.lower()).digest() for x in texts(batch)]  # bytes.lower changes A-Z only
    return as_batch(["doc_id", "sha", "fp"], [pa.int64(), pa.binary(), pa.int64()], [batch.column("doc_id"), found, [int.from_bytes(x[:8], "big", signed=True) for x in found]])


def _filters(top: int):
    """The filters of one partition, one for each value of the highest `top` bits that occurs."""

    def run(batches):
        parts = [b.column("fp").to_numpy(zero_copy_only=False) for b in batches]
        fps = np.sort(np.concatenate([*parts, np.zeros(0, np.int64)]).view(np.uint64))
        fps, counts = summed(fps, np.ones(len(fps), np.int64))
        key = (fps >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(fps), np.int64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(fps) else np.zeros(0, np.int64)
        for a, b in zip(first, np.r_[first[1:], len(fps)][: len(first)], strict=True):
            raw = CountingQuotientFilter.of(fps[a:b] & np.uint64((1 << (64 - top)) - 1), counts[a:b], 64 - top).to_bytes()
            yield as_batch(["key", "filter"], [pa.int64(), pa.binary()], [[int(key[a])], [raw]])

    return run


def _merged(top: int):
    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key: filters of a key are merged, and fingerprints that occur more than once come out."""
        open_key, open_filters = None, []

        def close():
            fps, counts = CountingQuotientFilter.merge(open_filters).items()
            fps = (fps | np.uint64(open_key << (64 - top) if top else 0))[counts > 1]
            return as_batch(["fp", "n"], [pa.int64()] * 2, [pa.array(fps.view(np.int64)), pa.array(counts[counts > 1])])

        for batch in groups:
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("filter").to_pylist(), strict=True):
                if open_key is not None and key != open_key:
                    yield close()
                    open_filters = []
                open_key = key
                open_filters.append(CountingQuotientFilter.from_bytes(raw))
                if len(open_filters) == 16:
                    open_filters = [CountingQuotientFilter.merge(open_filters)]
        if open_filters:
            yield close()

    return run


def repeated_fingerprints(digests: DataFrame, rows: int) -> DataFrame:
    """digests(fp) -> (fp, n): fingerprints that occur more than once, by merging the partitions' filters."""
    top = max(0, int(np.ceil(np.log2(max(1, rows) / RANGE_ROWS))))
    made = digests.select("fp").mapInArrow(_filters(top), "key long, filter binary")
    return made.repartition("key").sortWithinPartitions("key").mapInArrow(_merged(top), "fp long, n long")


def _normal(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [x.lower() for x in texts(batch)]
    fps = [int.from_bytes(hashlib.sha256(x).digest()[:8], "big", signed=True) for x in rows]
    return as_batch(["doc_id", "bytes", "fp"], [pa.int64(), pa.binary(), pa.int64()], [batch.column("doc_id"), rows, fps])


def exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """documents -> doc_id, keep_id, group_size, kept, text_sha256; one row per row.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts the largest doc_id is kept, a null
    only where there is no other; of rows that repeat that id as well one is kept. Other columns are ignored; an empty table
    gives no rows.
    """
    digests = materialise(spark, two(docs).mapInArrow(per_batch(_digest), "doc_id long, sha binary, fp long"), "digests")
    repeated = materialise(spark, repeated_fingerprints(digests, digests.count()), "repeated")
    candidates = two(docs).mapInArrow(per_batch(_normal), "doc_id long, bytes binary, fp long").join(repeated.select("fp"), "fp", "left_semi")
    # byte verification: the groups' key is the text itself, and a partition sends each of its texts once
    verified = candidates.groupBy("bytes").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(spark, verified.select(F.unhex(F.sha2("bytes", 256)).alias("sha"), "keep_id", "group_size").where("group_size > 1"), "groups")
    rows = digests.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(groups.withColumnRenamed("sha", "group_sha"), F.col("sha") == F.col("group_sha"), "left")
    keep = F.when(F.col("group_sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    rows = rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without exact copies, with their columns: of equal texts the row of the largest doc_id stays.

    Rows without a doc_id stay, as nothing names them; of rows that repeat id and text one stays.
    """
    found = materialise(spark, exact_duplicates(spark, docs).where("doc_id is not null and group_size > 1"), "found")
    rows = found.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    out = docs.join(rows.where("kept = 0").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    return out if rows.where("kept > 0 and n > 1").isEmpty() else out.where("doc_id is null").unionByName(out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
