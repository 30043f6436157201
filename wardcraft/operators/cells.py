"""Shapes as sets of grid cells, in runs: (key, cj, a, b) are the cells a to b of row cj. A cell is in a shape if its centre is.

Areas are right to about perimeter times cell size. A run takes one row whatever its length, so a shape has as many rows as its outline has
cells, not as its area has. A buffer's part in a row is one run, whose ends come from the shape's own equation.
Set operations sweep over the ends of all runs of a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcraft.functions.geometry import point_box
from wardcraft.plans.components import connected_components
from wardcraft.plans.shared import materialise


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: a generator stands between them and what is made of them, so that the optimizer doesn't write them out at every use."""
    return df.withColumn("_s", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))).select(*df.columns, "_s.*")


def _rows(df: DataFrame, c: float, low: str, high: str, pad: float) -> DataFrame:
    """A row for each grid row cj that [low - pad, high + pad] touches, with the y of its centres."""
    span = f"sequence(cast(floor(({low} - {pad}) / {c}) as bigint), cast(floor(({high} + {pad}) / {c}) as bigint))"
    return held(df.withColumn("cj", F.explode(F.expr(span))), _y=F.expr(f"(cj + 0.5e0) * {c}"))


def _run(rows: DataFrame, c: float, low: Column, high: Column, inside: str, keys: tuple[str, ...], merge: bool = True) -> DataFrame:
    """Rows -> runs of the cells whose centres lie in [low, high]. inside: the exact test of a centre at x `{x}`, which moves an end by one where rounding misplaced it."""
    at = lambda end: inside.format(x=f"(({end} + 0.5e0) * {c})")
    ends = held(rows, _a=F.ceil(low / c - 0.5).cast("long"), _b=F.floor(high / c - 0.5).cast("long")).where("_a is not null and _b is not null")
    ends = held(ends, **{"a": F.expr(f"case when {at('(_a - 1)')} then _a - 1 when {at('_a')} then _a else _a + 1 end"), "b": F.expr(f"case when {at('(_b + 1)')} then _b + 1 when {at('_b')} then _b else _b - 1 end")})
    runs = ends.where("a <= b").select(*keys, "cj", "a", "b")
    return merged(runs, *keys) if merge else runs


def buffer_points(points: DataFrame, radius: float, c: float, *keys: str) -> DataFrame:
    """Cells within the radius of any point."""
    half = F.sqrt(F.greatest(F.lit(0.0), F.expr(f"{radius * radius} - (_y - y) * (_y - y)")))
    rows = _rows(points.select(*keys, "x", "y").distinct(), c, "y", "y", radius)
    return _run(rows, c, F.col("x") - half, F.col("x") + half, f"(({{x}} - x) * ({{x}} - x) + (_y - y) * (_y - y) <= {radius * radius})", keys)


#: Rows of the grid that a task works on at once. Fixed value.
ROWS = 100_000


def _segment_runs(batches: Iterator[pa.RecordBatch], radius: float, c: float) -> Iterator[pa.RecordBatch]:
    """Batches of keys, x0, y0, x1, y1 -> keys, cj, a, b: the cells of each grid row whose centres lie in two discs and the rectangle between them.

    The ends come from the outline; the exact test of a centre moves one by a cell where rounding misplaced it.
    """
    square = radius * radius
    for batch in batches:
        keys = batch.select(batch.schema.names[:-4])
        ends = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns - 4, batch.num_columns)]
        first, last = np.floor((np.minimum(ends[1], ends[3]) - radius) / c), np.floor((np.maximum(ends[1], ends[3]) + radius) / c)
        known = np.isfinite(first + last + ends[0] + ends[2])
        first = np.where(known, first, 0).astype(np.int64)
        n = np.where(known, last - first + 1, 0).astype(np.int64)
        upto = np.cumsum(n)
        for start in range(0, int(n.sum()), ROWS):
            at = np.arange(start, min(start + ROWS, int(upto[-1])))
            of = np.searchsorted(upto, at, "right")
            cj = first[of] + at - (upto[of] - n[of])
            y = (cj + 0.5) * c
            x0, y0, x1, y1 = (e[of] for e in ends)
            dx, dy = x1 - x0, y1 - y0
            q = dx * dx + dy * dy
            with np.errstate(divide="ignore", invalid="ignore"):
                nx, ny = np.where(q == 0, 0.0, -radius * dy / np.sqrt(q)), np.where(q == 0, 0.0, radius * dx / np.sqrt(q))
                low, high = np.full(len(y), np.nan), np.full(len(y), np.nan)
                for x, z in ((x0, y0), (x1, y1)):
                    half = np.sqrt(np.where(np.abs(y - z) <= radius, square - (y - z) * (y - z), np.nan))
                    low, high = np.fmin(low, x - half), np.fmax(high, x + half)
                corners = [(x0 + nx, y0 + ny), (x1 + nx, y1 + ny), (x1 - nx, y1 - ny), (x0 - nx, y0 - ny)]
                for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
                    cut = np.where((ay != by) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by)), ax + (y - ay) / (by - ay) * (bx - ax), np.nan)
                    low, high = np.fmin(low, cut), np.fmax(high, cut)

            def near(cell, x0=x0, y0=y0, x1=x1, y1=y1, dx=dx, dy=dy, q=q, y=y):
                x = (cell + 0.5) * c
                along, across = (x - x0) * dx + (y - y0) * dy, (x - x0) * dy - (y - y0) * dx
                by_end = np.where(along <= 0, (x - x0) * (x - x0) + (y - y0) * (y - y0), (x - x1) * (x - x1) + (y - y1) * (y - y1)) <= square
                return np.where((along <= 0) | (along >= q), by_end, across * across <= square * q)

            a, b = np.ceil(low / c - 0.5), np.floor(high / c - 0.5)
            a = np.where(near(a - 1), a - 1, np.where(near(a), a, a + 1))
            b = np.where(near(b + 1), b + 1, np.where(near(b), b, b - 1))
            kept = np.flatnonzero(a <= b)
            columns = [*keys.take(pa.array(of[kept])).columns, pa.array(cj[kept]), pa.array(a[kept].astype(np.int64)), pa.array(b[kept].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*keys.schema.names, "cj", "a", "b"])


def buffer_segments(segments: DataFrame, radius: float, c: float, *keys: str, merge: bool = True) -> DataFrame:
    """Cells within the radius of any segment: of two discs and the rectangle between them. merge: runs become disjoint and as long as can be; else nothing is shuffled."""
    s = segments.select(*keys, *[F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")])
    schema = T.StructType([*s.schema.fields[:-4], *[T.StructField(k, T.LongType()) for k in ("cj", "a", "b")]])
    runs = (s.distinct() if merge else s).mapInArrow(partial(_segment_runs, radius=radius, c=c), schema)
    return merged(runs, *keys) if merge else runs


def buffer_boxes(boxes: DataFrame, radius: float, c: float, *keys: str, merge: bool = True) -> DataFrame:
    """Cells within the radius of any box; radius 0: of the boxes themselves."""
    boxes = boxes.select(*keys, "x0", "y0", "x1", "y1")
    rows = _rows(boxes.distinct() if merge else boxes, c, "y0", "y1", radius)
    half = F.expr(f"sqrt({radius * radius} - greatest(y0 - _y, 0e0, _y - y1) * greatest(y0 - _y, 0e0, _y - y1))")
    half = F.when(F.expr(f"greatest(y0 - _y, 0e0, _y - y1) <= {radius}"), half)
    return _run(rows, c, F.col("x0") - half, F.col("x1") + half, f"({point_box('{x}', '_y', 'x0', 'y0', 'x1', 'y1')} <= {radius})", keys, merge)


def fill_rings(edges: DataFrame, c: float, *keys: str, merge: bool = True) -> DataFrame:
    """Cells in polygons: edges(keys, x0, y0, x1, y1) of all rings, holes as well; a cell is in if its ray to the left crosses an odd number."""
    rows = _rows(edges, c, "least(y0, y1)", "greatest(y0, y1)", 0.0).where("(y0 > _y) <> (y1 > _y)")
    at = held(rows, _x=F.expr("x0 + (_y - y0) * (x1 - x0) / (y1 - y0)"))
    of = Window.partitionBy(*keys, "cj").orderBy("_x")  # a polygon's edges that cross one grid row
    pairs = at.withColumns({"_k": F.row_number().over(of), "_end": F.lead("_x").over(of)}).where("_k % 2 = 1")
    runs = pairs.select(*keys, "cj", F.expr(f"cast(ceil(_x / {c} - 0.5) as bigint)").alias("a"), F.expr(f"cast(ceil(_end / {c} - 0.5) as bigint) - 1").alias("b")).where("a <= b")
    return merged(runs, *keys) if merge else runs


def fill_polygons(polygons: DataFrame, c: float, *keys: str) -> DataFrame:
    """Runs of the cells in each polygon of a table with bounds and edges (spatial.polygons_of), by fill_rings' rule; of one polygon they are disjoint, and nothing is shuffled."""
    rows = _rows(polygons.select(*keys, "y0", "y1", "edges"), c, "y0", "y1", 0.0)
    crossed = "transform(filter(edges, e -> (e.y0 > _y) <> (e.y1 > _y)), e -> e.x0 + (_y - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0))"
    rows = held(rows.select(*keys, "cj", "_y", "edges"), _x=F.expr(f"array_sort({crossed})")).where("size(_x) > 1")
    run = f"struct(cast(ceil(_x[2 * k] / {c} - 0.5) as bigint) as a, cast(ceil(_x[2 * k + 1] / {c} - 0.5) as bigint) - 1 as b)"
    runs = rows.select(*keys, "cj", F.explode(F.expr(f"transform(sequence(0, cast(size(_x) div 2 as int) - 1), k -> {run})")).alias("r"))
    return runs.select(*keys, "cj", "r.a", "r.b").where("a <= b")


def buffer_rings(edges: DataFrame, radius: float, c: float, *keys: str) -> DataFrame:
    """Cells within the radius of any polygon; edges: keys, id of the polygon, then x0, y0, x1, y1 of the edges of all its rings."""
    ids = edges.columns[:-4]
    filled = fill_rings(edges, c, *ids, merge=False).select(*keys, "cj", "a", "b")
    return merged(filled.union(buffer_segments(edges, radius, c, *keys, merge=False)) if radius > 0 else filled, *keys)


def _swept(runs: DataFrame, keys: tuple[str, ...], keep: str) -> DataFrame:
    """runs(keys, cj, a, b, m, n), m and n 1 for the sets that a run is of -> disjoint runs where the condition on the numbers m and n of open runs holds.

    Each row of a key is swept by itself, over as many ends as its runs have.
    """
    ends = runs.select(*keys, "cj", F.explode(F.expr("array(struct(a as at, m as m, n as n), struct(b + 1 as at, -m as m, -n as n))")).alias("e")).select(*keys, "cj", "e.*")
    ends = ends.groupBy(*keys, "cj", "at").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "cj").orderBy("at")
    upto = of.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = ends.withColumns({"m": F.sum("m").over(upto), "n": F.sum("n").over(upto)}).withColumn("in", F.expr(keep))
    turns = open_.withColumn("was", F.lag("in", 1, False).over(of)).where("in <> was")
    return turns.withColumn("next", F.lead("at").over(of)).where("in").select(*keys, "cj", F.col("at").alias("a"), (F.col("next") - 1).alias("b"))


def merged(runs: DataFrame, *keys: str) -> DataFrame:
    """Disjoint runs of the same cells, as long as can be."""
    return _swept(runs.selectExpr(*keys, "cj", "a", "b", "1 as m", "0 as n"), keys, "m > 0")


def _both(a: DataFrame, b: DataFrame, keys: tuple[str, ...], keep: str) -> DataFrame:
    return _swept(a.selectExpr(*keys, "cj", "a", "b", "1 as m", "0 as n").union(b.selectExpr(*keys, "cj", "a", "b", "0 as m", "1 as n")), keys, keep)


def union(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return _both(a, b, keys or ("key",), "m > 0 or n > 0")


def intersect(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Cells of both; without keys, b is one shape for all keys of a."""
    if keys:
        return _both(a, b, keys, "m > 0 and n > 0")
    left, right = a, b.select("cj", F.col("a").alias("_a"), F.col("b").alias("_b"))
    return left.join(right, "cj").where("a <= _b and _a <= b").select(*a.columns[:-2], F.greatest("a", "_a").alias("a"), F.least("b", "_b").alias("b"))


def difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return _both(a, b, keys or ("key",), "m > 0 and n <= 0")


def touching(a: DataFrame, b: DataFrame, keys: tuple[str, ...], on: tuple[str, ...] = ()) -> DataFrame:
    """The distinct `keys` of pairs of runs, of a and of b, that have a cell in common; `on` has to be equal as well."""
    right = b.withColumnsRenamed({"a": "_a", "b": "_b"})
    return a.join(right, [*on, "cj"]).where("a <= _b and _a <= b").select(*keys).distinct()


def area(cells: DataFrame, c: float, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg((F.sum(F.expr("b - a + 1")) * c * c).alias("area"))


def parts(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """cells(key, cj, a, b), key a whole number under 2**14, runs disjoint -> with part: runs of one key that touch by a side have the same; it is the number of the part's smallest cell."""
    n = cells.withColumn("n", F.expr("key * 1125899906842624 + (a + 16777216) * 33554432 + (cj + 16777216)"))
    over = n.select("key", (F.col("cj") - 1).alias("cj"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n").alias("v"))
    edges = n.join(over, ["key", "cj"]).where("a <= _b and _a <= b").select(F.col("n").alias("u"), "v")
    roots = connected_components(spark, edges.repartitionByRange("u"))  # neighbours share a task, whose forest takes in most of them
    return n.join(roots, n.n == roots.node, "left").select("key", "cj", "a", "b", F.coalesce("root", "n").alias("part"))


def largest_part(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """The cells of each key's largest part, the one of the smallest cell on a tie."""
    found = materialise(spark, parts(spark, cells), "parts")
    best = found.groupBy("key", "part").agg(F.sum(F.expr("b - a + 1")).alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("part"))
    return found.join(best, ["key", "part"], "left_semi").drop("part")
