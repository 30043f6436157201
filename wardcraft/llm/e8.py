"""Near copies among embeddings: random projections decoded to points of the lattice E8, in several tables.

A table has `blocks` projections to 8 dimensions; a vector's place in each is its nearest lattice point or, as a probe, the second nearest, so
it stands in 2 ** blocks cells of a table. Blocks grow with the logarithm of the number of vectors, so that a cell holds few that aren't near;
tables are as many as give the wanted recall at the threshold, by a simulation with fixed seeds. Cells of one vector go before any vector is
moved; what shares a cell is compared by its cosine in double precision, all with all within a cell, large cells in pairs of parts.
A pair that shares several cells counts in the one of the least code, so links are counted, not written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.text import as_batch, only, table
from wardcraft.plans.components import connected_components
from wardcraft.plans.shared import materialise

LEAST, RECALL, PART, SEED = 0.95, 0.97, 1024, 8
#: Length in the lattice, on average, of the difference of two vectors at the threshold, and how many cells a block then tells apart.
REACH, CELLS = 0.55, 1150


@cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1, or all of a half with an even number of minus signs."""
    out = [[{i: a, j: b}.get(k, 0.0) for k in range(8)] for i, j in combinations(range(8), 2) for a in (1.0, -1.0) for b in (1.0, -1.0)]
    return np.array(out + [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points of whole coordinates with an even sum: all are rounded, and where the sum is odd the one farthest from its number goes to the other side."""
    out = np.rint(x)
    apart = x - out
    rows = np.flatnonzero(out.sum(1) % 2)
    k = np.abs(apart[rows]).argmax(1)
    out[rows, k] += np.where(apart[rows, k] >= 0, 1, -1)
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest lattice points of rows of 8 numbers: E8 is the even points and the same moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


class Tables:
    """Random projections of `dim` numbers and the cells of vectors in them."""

    def __init__(self, dim: int, blocks: int, tables: int, least: float = LEAST, seed: int = SEED):
        r = np.random.default_rng([seed, dim])
        self.blocks, self.tables = blocks, tables
        n = blocks * tables
        made = r.normal(size=(n, dim, 8))
        made = np.linalg.qr(made)[0] if dim >= 8 else made / np.sqrt(8)
        scale = REACH / np.sqrt(2 - 2 * least) / np.sqrt(min(8, dim) / dim)
        self.project = np.concatenate(list(made * scale), axis=1)
        self.shift = r.uniform(0, 1, n * 8)
        self.weight = r.integers(-(1 << 62), 1 << 62, (n, 8)) * 2 + 1
        self.moves = np.stack([(2 * roots()).astype(np.int64) @ w for w in self.weight])
        self.salt = r.integers(-(1 << 62), 1 << 62, tables)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors -> codes by row, table and cell."""
        y = x @ self.project + self.shift
        own, other = [], []
        for k in range(self.blocks * self.tables):
            at = y[:, 8 * k : 8 * k + 8]
            point = decode(at)
            code = (2 * point).astype(np.int64) @ self.weight[k]
            own.append(code)
            other.append(code + self.moves[k][((at - point) @ roots().T).argmax(1)])
        out = np.empty((len(x), self.tables, 1 << self.blocks), np.int64)
        for t in range(self.tables):
            for i, take in enumerate(product((own, other), repeat=self.blocks)):
                out[:, t, i] = self.salt[t] + sum(of[t * self.blocks + b] for b, of in enumerate(take))
        return out


@cache
def _met(dim: int, least: float, rows: int = 20_000) -> float:
    """How often two vectors at the threshold share a cell of one block."""
    r = np.random.default_rng(SEED)
    a, g = (x / np.linalg.norm(x, axis=1)[:, None] for x in r.normal(size=(2, rows, dim)))
    g -= (g * a).sum(1)[:, None] * a
    b = least * a + np.sqrt(1 - least * least) * g / np.linalg.norm(g, axis=1)[:, None]
    t = Tables(dim, 1, 1, least, SEED + 1)
    p, q = t.cells(a)[:, 0], t.cells(b)[:, 0]
    return float((p[:, :, None] == q[:, None, :]).any((1, 2)).mean())


def sizes(rows: int, dim: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """(blocks, tables) for so many vectors: others in a cell by chance are one in four at most."""
    blocks = max(1, ceil(log(4 * max(rows, 1)) / log(CELLS / 2)))
    hit = _met(dim, least) ** blocks if dim > 1 else 1.0
    return blocks, max(1, ceil(log(1 - recall) / log(1 - min(hit, 1 - 1e-9))))


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield batch.filter(pa.array(dims == dim)), int(dim)


def _cells(made: dict[int, tuple[int, int]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = only(("e8", least, tuple(made.items())), lambda: {d: Tables(d, *s, least) for d, s in made.items()})
        for batch in batches:
            for part, dim in _by_length(batch):
                for k in range(0, part.num_rows, 2000):
                    rows = part.slice(k, 2000)
                    codes = tables[dim].cells(unit(rows.column("embedding"), dim)).reshape(rows.num_rows, -1)
                    yield as_batch(["code", "node"], [pa.int64()] * 2, [pa.array(codes.ravel()), pa.array(np.repeat(rows.column("node").to_numpy(), codes.shape[1]))])

    return run


def _compare(a: np.ndarray, b: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a, or of a and b, whose cosine is at least `least`."""
    near = a @ (a if b is None else b).T >= least
    return np.nonzero(np.triu(near, 1) if b is None else near)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (code, i, j), which come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("code", "i", "j")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and any(held[-1].column(c)[-1] != batch.column(c)[a] for c in ("code", "i", "j")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _links(made: dict[int, tuple[int, int]], least: float):
    """Members of cells with their vectors, sorted by cell -> (node, links, root): links that count here, and the smallest node that this cell joins it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = only(("e8", least, tuple(made.items())), lambda: {d: Tables(d, *s, least) for d, s in made.items()})
        for group in _groups(batches):
            code, i, j = (group.column(c)[0].as_py() for c in ("code", "i", "j"))
            for part, dim in _by_length(group.combine_chunks().to_batches()[0]):
                node, n, at = (part.column(c).to_numpy() for c in ("node", "n", "part"))
                x = unit(part.column("embedding"), dim)
                left, right = (np.arange(len(x)), None) if i == j else (np.flatnonzero(at == i), np.flatnonzero(at == j))
                p, q = _compare(x[left], None if right is None else x[right], least)
                p, q = left[p], (left if right is None else right)[q]
                if not len(p):
                    continue
                used, spot = np.unique(np.concatenate([p, q]), return_inverse=True)
                p, q = spot[: len(p)], spot[len(p) :]
                codes, links = tables[dim].cells(x[used]), np.zeros(len(used), np.int64)
                for k in range(0, len(p), 20_000):
                    a, b = codes[p[k : k + 20_000]], codes[q[k : k + 20_000]]
                    first = np.where(a[:, :, :, None] == b[:, :, None, :], a[:, :, :, None], np.iinfo(np.int64).max).min((1, 2, 3)) == code
                    a, b = p[k : k + 20_000][first], q[k : k + 20_000][first]
                    np.add.at(links, a, n[used[b]])
                    np.add.at(links, b, n[used[a]])
                root = node[used]
                while True:  # the least node goes round until nothing changes
                    least_of = root.copy()
                    np.minimum.at(least_of, p, root[q])
                    np.minimum.at(least_of, q, root[p])
                    if (least_of == root).all():
                        break
                    root = least_of
                yield as_batch(["node", "links", "root"], [pa.int64()] * 3, [pa.array(c) for c in (node[used], links, root)])

    return run


def _usable(x: Column) -> Column:
    """Not null, not zero, all components numbers."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(F.forall(x, number) & F.exists(x, lambda v: F.coalesce(v != 0, F.lit(False))), F.lit(False))


def near_vectors(spark: SparkSession, embeddings: DataFrame, least: float = LEAST, recall: float = RECALL, part: int = PART) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, n_links, component_id, kept.

    A row per row. Vectors that are null, zero or hold what is no finite number have no links; so have vectors of different lengths. Equal
    vectors are compared once and count each. Of rows without a vec_id none names a component unless nothing else is there; of rows that
    repeat the smallest vec_id all are kept. Other columns are ignored; an empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("usable", _usable(F.col("embedding")))
    named = rows.withColumns({"h": F.when(F.col("usable"), F.xxhash64("embedding")), "g": F.when(F.col("usable"), F.xxhash64("embedding", F.lit(1)))})
    classes = named.where("usable").groupBy("h", "g").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = materialise(spark, classes.select(F.monotonically_increasing_id().alias("node"), "h", "g", "least", "n", F.size("embedding").alias("dim"), "embedding"), "classes")
    made = {r.dim: sizes(r.n, r.dim, least, recall) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length of vectors
    cells = classes.select("node", "dim", "embedding").mapInArrow(_cells(made, least), "code long, node long")
    shared = materialise(spark, cells.groupBy("code").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "cells")
    members = cells.join(shared, "code").withColumn("parts", F.expr(f"cast(ceil(m / {part}e0) as int)"))
    members = members.withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    members = members.select("code", "node", "part", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    members = members.select("code", "node", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    full = members.join(classes.select("node", "n", "dim", "embedding"), "node").repartition("code", "i", "j").sortWithinPartitions("code", "i", "j")
    found = materialise(spark, full.mapInArrow(_links(made, least), "node long, links long, root long"), "links")
    roots_ = connected_components(spark, found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    links = found.groupBy(F.col("node").alias("k")).agg(F.sum("links").alias("links"))
    of = classes.join(roots_.withColumnsRenamed({"node": "k", "root": "top"}), F.col("node") == F.col("k"), "left").select("node", "h", "g", "n", "least", F.coalesce("top", "node").alias("top"))
    lowest = of.groupBy("top").agg(F.min("least").alias("component_id"))
    of = of.join(lowest, "top").join(links, F.col("node") == F.col("k"), "left").select("h", "g", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = named.drop("embedding").join(of, ["h", "g"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op11_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))
