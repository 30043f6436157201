"""Operator 7 for texts that share most of their shingles: SimHash with heavy-tailed weights, one byte at a time.

A plain SimHash weighs all shingles alike, so two texts of 0.8 Jaccard similarity differ in about 15 % of its bits: 3 of 64 bits
link few of them, and no index finds 10 of 64. Here each shingle has a weight of its own at each of `BANDS * ROWS` byte
positions, u ** (-1 / a) for a uniform hash u. For a towards 0 the greatest weight outdoes the sum of all others, so the sign
of each of the position's 8 sums is that shingle's bit. Two texts then share a positional byte with the probability of
their Jaccard similarity (and 1/256 of the rest), and the inverted index of byte positions works as for plain fingerprints:

- a posting is `ROWS` neighbouring positional bytes, so that postings don't grow with the square of the corpus; a pair of
  similarity 0.8 has a posting in common but for a probability of (1 - 0.8**5)**25 = 0.00005;
- within a posting the shared positional bytes of each pair are tallied. A pair of similarity 0.8 shares 100 of the 125 on
  average, with a deviation of 4.5; pairs under four deviations less go (`least_shared`: a loss of under 0.0001);
- the others are verified by their exact similarity.

A text's shingles are its runs of `words` words (ASCII lower case, split at white space); a shorter text is one shingle.
Postings with the same members are taken once. Only members of a posting of two or more send their shingle sets. A
posting above `most` members, or whose sets are above `MOST_BYTES`, is dealt out in chunks, and then only members that are not in its
main component meet the other chunks, in blocks: no pair that could join two components is left out, no task holds more than two
chunks, and a large group of copies is not compared all with all.

Fingerprints of at most `bits` differing bits (plain operator 7) link as well: they meet copies with so many small edits that
their shingles fall under the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.simhash import BITS, components, fingerprint, one_of_each, similar_fingerprints
from wardcraft.llm.text import as_batch, only, slices, texts
from wardcraft.plans.components import connected_components
from wardcraft.plans.shared import materialise

WORDS, SIMILARITY, MOST, MOST_BYTES = 5, 0.8, 1024, 32 << 20
BANDS, ROWS = 25, 5
_R = np.random.default_rng(42)
_A, _B = (_R.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in UTF-8."""
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in text.lower().split()], np.uint64)
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, np.uint64(size))
    for k in range(size):
        out = _mix(out * _P + w[k : k + len(out)])
    return np.unique(out)


def positional(found: np.ndarray) -> np.ndarray:
    """The positional bytes of shingle hashes: at each position 8 bits of the shingle of the greatest weight there."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(found), 512):  # so that what is computed stays in the processor's cache
        x = found[k : k + 512] * _A[:, None] + _B[:, None]
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(1))
    return (_mix(least) & np.uint64(0xFF)).astype(np.uint8)


def bands(fp: np.ndarray) -> np.ndarray:
    """The postings of positional bytes: one for each run of ROWS positions, with the run's number."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in fp.reshape(BANDS, ROWS).T:
        key = key << np.uint64(8) | column.astype(np.uint64)
    return key


def least_shared(similarity: float) -> int:
    """Positional bytes that a pair of this similarity shares but for four deviations."""
    n = BANDS * ROWS
    return max(0, int(n * similarity - 4 * (n * similarity * (1 - similarity)) ** 0.5))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, sorted, have this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both >= similarity * (len(a) + len(b) - both)


def links_within(fps: np.ndarray, sets: list[np.ndarray], similarity: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of the links among sets that has the components of all links. label: of each set, the component it is known to be in.

    Of each set the shared positional bytes with all later ones of other components are tallied at once; those that share
    enough are verified, at once as well: what their members are in the set is looked up in one table of all members.
    """
    n, out = len(sets), []
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    least = least_shared(similarity)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    flat = mark = None
    for i in range(n - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if len(j):
            j = j[(fps[j] == fps[i]).sum(1) >= least]
        if not len(j):
            continue
        if len(j) < 16:
            good = [k for k in j.tolist() if similar(sets[i], sets[k], similarity)]
        else:
            if flat is None:
                members, flat = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.zeros(len(members), bool)
            own = flat[ends[i] - sizes[i] : ends[i]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], ends - sizes)[j]  # no set is empty
            mark[own] = False
            good = j[both >= similarity * (sizes[i] + sizes[j] - both)].tolist()
        for k in good:
            if label[k] != label[i]:
                out.append((i, k))
                label[label == label[k]] = label[i]
    return out


def packed(found: np.ndarray) -> bytes:
    """A set of shingle hashes by their lowest 40 bits, 5 bytes each: sets are what is shuffled most. Of a pair of 10,000 shingles one in 5,000 has two that become one."""
    low = np.unique(found & np.uint64((1 << 40) - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """The numbers of packed, sorted."""
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def _postings(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(None)
        for batch in (part for whole in batches for part in slices(whole)):
            found = texts(batch)
            sets = [shingles(x, words) for x in found]
            keys = np.concatenate([bands(positional(x)) for x in sets] or [np.zeros(0, np.uint64)])
            fp = np.frombuffer(b"".join([fingerprint(x) for x in found]), ">i8").astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64)))
            yield as_batch(["node", "fp", "size", "keys"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())], [batch.column("node"), pa.array(fp), [5 * len(x) for x in sets], lists])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(None)
        for batch in (part for whole in batches for part in slices(whole, 100)):
            sets = [shingles(x, words) for x in texts(batch)]
            yield as_batch(["node", "bytes", "shingles"], [pa.int64(), pa.binary(), pa.binary()], [batch.column("node"), [positional(x).tobytes() for x in sets], [packed(x) for x in sets]])

    return run


def _verified(similarity: float):
    """Sorted rows (key, part, label, node, bytes, shingles) -> links (u, v). label: the component the node is known to be in."""

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list({r[1]: r for r in rows}.values())  # a block's node may be on both of its sides
        if len(rows) < 2:
            return
        fps = np.frombuffer(b"".join([r[2] for r in rows]), np.uint8).reshape(len(rows), -1)
        if found := links_within(fps, [unpacked(r[3]) for r in rows], similarity, np.array([r[0] for r in rows])):
            yield as_batch(["u", "v"], [pa.int64()] * 2, [[rows[a][1] for a, _ in found], [rows[b][1] for _, b in found]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(None)
        now, held = None, []
        for batch in (part for whole in batches for part in slices(whole, 100)):
            key, part, *rows = (c.to_pylist() for c in batch.columns)
            for k, p, *row in zip(key, part, *rows, strict=True):
                if (k, p) != now:
                    yield from links(held)
                    now, held = (k, p), []
                held.append(row)
        yield from links(held)

    return run


def _links(spark: SparkSession, members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members(key, part, label, node) -> links (u, v) between members of one part with different labels."""
    sent = members.join(sets, "node").select("key", "part", "label", "node", "bytes", "shingles").repartition("key", "part").sortWithinPartitions("key", "part")
    return materialise(spark, sent.mapInArrow(_verified(similarity), "u long, v long"), "links")


def _chunk(*of: str):
    """Which of `chunks` a row goes to, by a hash of these columns."""
    return F.pmod(F.xxhash64(*of, F.lit(2)), F.col("chunks"))


def _across(spark: SparkSession, members: DataFrame, links: DataFrame, most: int) -> DataFrame | None:
    """members(key, node, chunks) of postings of several chunks, links within the chunks -> blocks (key, part, label, node), or None if nothing is left.

    Members of a posting's main component are in one component already. Each other one meets every chunk: blocks
    of the others times the chunks, so rows grow with the members plus the others times the chunks.
    """
    roots = connected_components(spark, links)
    known = materialise(spark, members.join(roots, members.node == roots.node, "left").select("key", members.node, "chunks", F.coalesce("root", members.node).alias("label")), "known")
    main = known.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("m"))
    main = materialise(spark, main.where("n > m").select("key", "main", F.ceil((F.col("n") - F.col("m")) / most).cast("long").alias("blocks")), "main")
    if main.isEmpty():
        return None
    found = known.join(main, "key")
    part = F.col("chunk") * F.col("blocks") + F.col("block")
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))
    held = found.withColumn("chunk", _chunk("node", "key")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    others = found.where("label <> main").withColumn("block", block).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
    return held.union(others.select(held.columns)).select("key", part.alias("part"), "label", "node")


def near_copies(spark: SparkSession, docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bits: int = BITS, most: int = MOST) -> DataFrame:
    """documents -> doc_id, fp long (a hash of the text), component_id: the smallest doc_id that links of at least `similarity` or at most `bits` bits reach.

    One row per row of docs. A null text counts as empty, and texts without words are alike; a null doc_id is kept and never a
    component_id unless nothing else is there; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    made = materialise(spark, rows.select("node", "text").mapInArrow(_postings(words), "node long, fp long, size long, keys array<long>"), "bands")
    posted = made.select("node", "size", F.explode("keys").alias("key")).distinct()
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 24)).alias("y"))
    once = sizes.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("bytes") / MOST_BYTES)).cast("long")
    members = materialise(spark, posted.join(once.select("key", chunks.alias("chunks")), "key").select("key", "node", "chunks"), "members")
    needed = rows.select("node", "text").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sets = materialise(spark, needed.mapInArrow(_sets(words), "node long, bytes binary, shingles binary"), "sets")
    links = _links(spark, members.select("key", _chunk("node", "key").alias("part"), F.col("node").alias("label"), "node"), sets, similarity)
    large = members.where("chunks > 1")
    if not large.isEmpty() and (blocks := _across(spark, large, links, most)) is not None:
        links = links.union(_links(spark, blocks, sets, similarity))
    first = materialise(spark, made.groupBy("fp").agg(F.min("node").alias("first")), "first")  # a node for each fingerprint
    same = made.join(first, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = similar_fingerprints(spark, first.select("fp"), bits)
    for c in ("u", "v"):
        near = near.join(first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_")), c).drop(c).withColumnRenamed(f"{c}_", c)
    links = links.union(same).union(near.select("u", "v"))
    fps = rows.select("doc_id", F.col("node").alias("fp"))
    return components(fps, fps.groupBy("fp").agg(F.min("doc_id").alias("least")), connected_components(spark, links))


def drop_near_copies(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    """docs without near copies, with their columns: of each component the row of the smallest doc_id stays.

    Rows without a doc_id stay, as nothing names them; of rows that repeat id and text one stays.
    """
    return one_of_each(spark, docs, near_copies(spark, docs, **kw))
