"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Two 64-bit fingerprints with at most 3 differing bits differ in at most 3 of their 8 bytes, so they share at least
5 positional bytes (position, value). Postings of single positional bytes would grow with the square of the
corpus; a posting here is four positional bytes at once. The 14 blocks of the Steiner system S(3, 4, 8) are the
least family in which any 5 shared positions contain a whole block, so no pair that reaches the minimum is missed.
Within a posting the shared positional bytes of each pair are tallied, pairs under 5 go, the others are verified by
their differing bits. Postings above `most` members are never dealt out by themselves but again by the same scheme over the nibbles and
then the bit pairs that their block leaves free; after that a posting has at most 256 members. No pairs are
written: a posting gives a forest of its links, which holds the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.text import as_batch, per_batch, table, texts, two
from wardcraft.plans.components import connected_components
from wardcraft.plans.shared import materialise

WORDS, SEED, BITS, MOST = 3, 42, 3, 2048
#: S(3, 4, 8): fixed values.
BLOCKS = [(0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (0, 2, 4, 6), (0, 2, 5, 7), (0, 3, 4, 7), (0, 3, 5, 6), (1, 2, 4, 7), (1, 2, 5, 6), (1, 3, 4, 6), (1, 3, 5, 7), (2, 3, 4, 5), (2, 3, 6, 7), (4, 5, 6, 7)]


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> bytes:
    """8 bytes, the highest bit first, of a text in UTF-8."""
    w = text.lower().split()
    if not w:
        return bytes(8)
    n = max(1, len(w) - words + 1)
    count = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, n, 50_000):
        part = range(i, min(n, i + 50_000))
        joined = b"".join([digest(b" ".join(w[k : k + words]), seed) for k in part])
        count += np.unpackbits(np.frombuffer(joined, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(count * 2 > n).tobytes()


def _fingerprints(words: int, seed: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.frombuffer(b"".join([fingerprint(x, words, seed) for x in texts(batch)]), ">i8").astype(np.int64)
        return as_batch(["doc_id", "fp"], [pa.int64()] * 2, [batch.column("doc_id"), pa.array(fp)])

    return per_batch(run)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(fixed: int = 0, level: int = 0) -> list[int]:
    """The 14 masks of a level: blocks over 8 equal groups of the bits that `fixed` leaves free."""
    free = [b for b in range(64) if not fixed >> b & 1]
    size = len(free) // 8
    groups = [sum(1 << b for b in free[i * size : (i + 1) * size]) for i in range(8)]
    return [fixed | sum(groups[i] for i in block) for block in BLOCKS]


def links_within(key: np.ndarray, fp: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """key: number of the posting, sorted; fp: uint64. A forest, as pairs of rows, of the links within postings."""
    n = len(fp)
    label = np.arange(n)
    out: list[tuple[int, int]] = []
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    left = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n])) - np.arange(n)  # rows from here to the posting's end
    shift, rows = 1, np.flatnonzero(left > 1)
    while len(rows):
        other = rows + shift
        apart = label[rows] != label[other]
        i, j = rows[apart], other[apart]
        differ = fp[i] ^ fp[j]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # tally of shared positional bytes
        enough = shared >= 8 - bits
        i, j, differ = i[enough], j[enough], differ[enough]
        near = np.bitwise_count(differ) <= bits
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            x, y = label[a], label[b]
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)
                out.append((a, b))
        if near.any():
            while (label != (up := label[label])).any():
                label = up
        shift += 1
        rows = rows[left[rows] > shift]
    return out


def _postings(bits: int):
    """Sorted rows (mask, val, fp) -> links (u, v)."""

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        mask, val, fp = rows
        key = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])])
        if found := links_within(key, fp.view(np.uint64), bits):
            i, j = np.array(found).T
            yield as_batch(["u", "v"], [pa.int64()] * 2, [pa.array(fp[i]), pa.array(fp[j])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # the posting that may go on in the next batch
        for batch in batches:
            rows = np.concatenate([held, [c.to_numpy(zero_copy_only=False) for c in batch.columns]], axis=1)
            if rows.shape[1]:
                last = int(np.argmax((rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])))
                held = rows[:, last:]
                if last:
                    yield from links(np.ascontiguousarray(rows[:, :last]))
        if held.shape[1]:
            yield from links(np.ascontiguousarray(held))

    return run


def _pick(mask: Column, level: int) -> Column:
    """The masks of the next level for each mask of this one, as an array."""
    before = [0]
    for n in range(level):
        before = [m for f in before for m in masks(f, n)]
    if level == 0:
        return F.array(*[F.lit(_signed(m)) for m in masks()])
    return F.element_at(F.create_map(*[x for f in sorted(set(before)) for x in (F.lit(_signed(f)), F.array(*[F.lit(_signed(m)) for m in masks(f, level)]))]), mask)


def similar_fingerprints(spark: SparkSession, fps: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """fps(fp), distinct longs -> (u, v): links of at most `bits` <= 3 differing bits whose components are those of all links."""
    if not 0 <= bits <= 3 or most < 256:
        raise ValueError("bits is 0 to 3, most is 256 or more")
    rows = fps.select(F.col("fp"), F.lit(0).cast("long").alias("mask"))
    found, level = None, 0
    while True:
        posted = rows.select(F.explode(_pick(F.col("mask"), level)).alias("mask"), "fp").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("val"), "fp")
        posted = posted.distinct() if level else posted
        # how large postings are is summed up before anything is dealt by them, so that no task gets a large one
        large = posted.groupBy("mask", "val").count().where(F.col("count") > most).select("mask", "val")
        last = large.isEmpty()
        large = large if last else materialise(spark, large, f"large{level}")
        small = posted if last else posted.join(large, ["mask", "val"], "left_anti")
        links = materialise(spark, small.repartition("mask", "val").sortWithinPartitions("mask", "val").mapInArrow(_postings(bits), "u long, v long"), f"postings{level}")
        found = links if found is None else found.union(links)
        if last:
            return found
        rows = materialise(spark, posted.join(large, ["mask", "val"], "left_semi").select("fp", "mask"), f"dealt{level}")
        level += 1


def components(fps: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """fps(doc_id, fp), distinct(fp, least) and the components of linked fps -> doc_id, fp, component_id."""
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = roots.select(F.col("root").alias("fp")).distinct()  # only components of several fingerprints need a minimum
    least = member.join(linked.withColumnRenamed("fp", "root"), "root", "left_semi").groupBy("root").agg(F.min("least").alias("component"))
    of = member.join(least, "root", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS, seed: int = SEED, bits: int = BITS, most: int = MOST) -> DataFrame:
    """documents -> doc_id, fp long, component_id: the smallest doc_id that links of at most `bits` bits reach.

    One row per row of docs. A null or empty text has fingerprint 0, linked like any other; fewer words than a
    shingle needs give one shingle; equal rows share a component; a null doc_id is kept and never a
    component_id unless nothing else is there; other columns are ignored; an empty table gives no rows.
    """
    fps = materialise(spark, two(docs).mapInArrow(_fingerprints(words, seed), "doc_id long, fp long"), "fingerprints")
    distinct = materialise(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = similar_fingerprints(spark, distinct.select("fp"), bits, most)
    return components(fps, distinct, connected_components(spark, links))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    """docs without near copies, with their columns: of each component the row of the smallest doc_id stays.

    Rows without a doc_id stay, as nothing names them; of rows that repeat id and text one stays.
    """
    return one_of_each(spark, docs, near_duplicates(spark, docs, **kw))


def one_of_each(spark: SparkSession, docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows of which `found` (doc_id, component_id) names a smaller doc_id."""
    found = materialise(spark, found, "near")
    gone = found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("away"), F.count(F.lit(1)).alias("n"))
    gone = materialise(spark, gone.where("doc_id is not null and (away or n > 1)"), "gone")
    out = docs.join(gone.where("away").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    return out if gone.where("not away").isEmpty() else out.where("doc_id is null").unionByName(out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
