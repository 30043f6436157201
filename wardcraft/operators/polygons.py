"""Coverage shapes of sections as cell sets, after the two published recipes. All lengths are parameters in units of the working system.

Buildings are boxes, or polygons where the table has edges (spatial.polygons_of); the boundary is a table of edges of all its rings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.operators import cells, overlay, spatial
from wardcraft.plans.shared import materialise
from wardcraft.sources import wkb

#: What describes a shape by seeds, beside its section and street. Fixed value.
METHOD = "seed_buildings_plus_strip"


def _edges(boxes: DataFrame, *keys: str) -> DataFrame:
    """keys, bld_id and the edges of the shapes."""
    box = "array(struct(x0 as x0, y0 as y0, x1 as x1, y0 as y1), struct(x1 as x0, y0 as y0, x1 as x1, y1 as y1), struct(x1 as x0, y1 as y0, x0 as x1, y1 as y1), struct(x0 as x0, y1 as y0, x0 as x1, y0 as y1))"
    return boxes.select(*keys, "bld_id", F.explode("edges" if "edges" in boxes.columns else F.expr(box)).alias("e")).select(*keys, "bld_id", "e.x0", "e.y0", "e.x1", "e.y1")


def _buffer(boxes: DataFrame, radius: float, c: float, *keys: str) -> DataFrame:
    """Cells within the radius of the shapes."""
    if "edges" not in boxes.columns:
        return cells.buffer_boxes(boxes, radius, c, *keys)
    return cells.buffer_rings(_edges(boxes, *[k for k in keys if k != "bld_id"]), radius, c, *keys)


def _runs(shapes: DataFrame, radius: float, c: float, *keys: str) -> DataFrame:
    """As _buffer, shape by shape: runs may overlap or repeat, and nothing is shuffled."""
    if "edges" not in shapes.columns:
        return cells.buffer_boxes(shapes, radius, c, *keys, merge=False)
    filled = cells.fill_polygons(shapes, c, *keys)
    if radius <= 0:
        return filled
    edges = shapes.select(*keys, F.explode("edges").alias("e")).select(*keys, "e.x0", "e.y0", "e.x1", "e.y1")
    return filled.union(cells.buffer_segments(edges, radius, c, *keys, merge=False))


def _on_side(spark: SparkSession, shapes: DataFrame, side: DataFrame, c: float) -> DataFrame:
    """shapes with keys, an array -> bld_id, keys: those of the keys whose side (key, cj, a, b) has a cell of the shape. Shapes with the same run meet a side once."""
    own = materialise(spark, _runs(shapes, 0.0, c, "bld_id", "keys"), "own")
    runs = own.select("keys", "cj", "a", "b").distinct().select(F.explode("keys").alias("key"), "cj", "a", "b").distinct()
    of = cells.touching(runs, side, ("cj", "a", "b", "key"), ("key",)).groupBy("cj", "a", "b").agg(F.collect_set("key").alias("of"))
    met = own.join(of, ["cj", "a", "b"]).select("bld_id", F.array_intersect("keys", "of").alias("of")).where("size(of) > 0")
    return met.groupBy("bld_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("of")))).alias("keys"))


def _sampled_segments(samples: DataFrame) -> DataFrame:
    return spatial.segments_of(samples.select("line_id", F.col("i").alias("seq"), "x", "y"))


def seed_layers(points: DataFrame, boxes: DataFrame, segments: DataFrame, local: float = 500.0, pad: float = 10.0, frontage: float = 35.0, max_seed: float = 350.0, n: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(street, corridor, chosen): the sampled street along each section's points, the shapes in its corridor, and for each point its seed
    (bld_id, d) or the reason why it has none (`debug_layers`). ValueError if no section has a street near its points, or none has a building by its street."""
    of_line = points.select("line_id", "key").distinct()
    kept = spatial.close_segments(points, segments, local)
    street = _sampled_segments(spatial.samples(spatial.measures(points, kept), kept, n, pad)).join(of_line, "line_id")
    street = materialise(points.sparkSession, street, "street")
    if street.isEmpty():
        raise ValueError(f"no part of a street within {local} of its points")
    corridor = materialise(points.sparkSession, spatial.meeting(boxes, street, frontage), "corridor")
    if corridor.isEmpty():
        raise ValueError(f"no building within {frontage} of a street")
    return street, corridor, spatial.seeds(points, boxes, corridor, max_seed)


def debug_layers(points: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, failed): pt_id, best_d, x, y of the points that have a seed; pt_id, reason, x, y of those that don't."""
    at = chosen.join(points.select("pt_id", "x", "y"), "pt_id")
    return at.where("reason is null").select("pt_id", F.col("d").alias("best_d"), "x", "y"), at.where("reason is not null").select("pt_id", "reason", "x", "y")


def layer(spark: SparkSession, shape: DataFrame, c: float, named: DataFrame, method: str | None = None, **lengths: float) -> DataFrame:
    """Cells (key, cj, a, b) of sections and named(key, street) -> sv, street, [method, the lengths by name], wkb: a multipolygon each.

    lengths of a shape by seeds are frontage_dist, max_seed_dist, grow_m, fill_m and strip_depth.
    """
    found = overlay.shapes(overlay.cell_rings(spark, shape, c)).join(named, "key")
    more = [F.lit(method).alias("method")] if method else []
    return found.select(F.col("key").alias("sv"), "street", *more, *[F.lit(v).alias(k) for k, v in lengths.items()], "wkb")


_EDGE_ROWS = "key long, ring long, hole boolean, x0 double, y0 double, x1 double, y1 double"


def _edges_of_wkb(batches):
    for batch in batches:
        for key, raw in zip(batch.column("key").to_pylist(), batch.column("wkb"), strict=True):
            if not raw.is_valid:
                continue
            kind, parts, _ = wkb.load(raw.as_py())
            parts = {"Polygon": [parts], "MultiPolygon": parts}.get(kind, [])
            ring = -1
            for part in parts:
                for k, points in enumerate(part):
                    ring += 1
                    xy = np.array(points)[:, :2]
                    n = len(xy) - 1
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([ring] * n, pa.int64()), pa.array([k > 0] * n), *[pa.array(np.ascontiguousarray(c)) for c in (xy[:-1, 0], xy[:-1, 1], xy[1:, 0], xy[1:, 1])]], [f.split()[0] for f in _EDGE_ROWS.split(", ")])


def edges_of(shapes: DataFrame) -> DataFrame:
    """shapes(key, wkb) -> key, ring, hole, x0, y0, x1, y1: the edges of polygons and multipolygons; others have none."""
    return shapes.select(F.col("key").cast("long").alias("key"), "wkb").mapInArrow(_edges_of_wkb, _EDGE_ROWS)


def dissolve(spark: SparkSession, shapes: DataFrame, snap: float = 1e-6) -> DataFrame:
    """shapes(key, id, wkb) -> vertices of the rings of each key's polygons as one shape, repaired as well (see overlay.dissolved)."""
    numbered = shapes.select("key", "wkb", F.xxhash64("key", "id").alias("of"))
    edges = edges_of(numbered.select(F.col("of").alias("key"), "wkb")).withColumn("of", F.col("key")).drop("key").join(numbered.select("of", "key").distinct(), "of")
    edges = edges.select("key", F.struct("of", "ring").alias("ring"), "hole", "x0", "y0", "x1", "y1")
    return overlay.dissolved(spark, overlay.oriented(edges, F.col("hole")), snap)


def boundary(spark: SparkSession, shapes: DataFrame, name: str, source: str = "extract", snap: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """shapes(id, wkb) -> (layer, edges): one row of name, source, wkb with all polygons as one, and its edges (x0, y0, x1, y1) for clipping."""
    vertices = dissolve(spark, shapes.select(F.lit(0).cast("long").alias("key"), "id", "wkb"), snap)
    vertices = materialise(spark, vertices, "boundary")
    found = overlay.shapes(vertices).select(F.lit(name).alias("name"), F.lit(source).alias("source"), "wkb")
    return found, overlay.ring_edges(vertices).select("x0", "y0", "x1", "y1")


def buildings_within(shapes: DataFrame, outline: DataFrame, transform=None) -> DataFrame:
    """shapes(bld_id, wkb) of buildings and the outline's edges -> polygons (as of spatial.polygons_of) of those that have a place in the outline.

    transform: Columns x, y -> Columns of the working system, in which the outline and the result are.
    """
    edges = edges_of(shapes.select(F.col("bld_id").alias("key"), "wkb")).withColumnRenamed("key", "bld_id")
    if transform:
        (x0, y0), (x1, y1) = (transform(F.col(f"x{k}"), F.col(f"y{k}")) for k in (0, 1))
        edges = edges.select("bld_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    met = spatial.meeting_polygons(edges.select(F.col("bld_id").alias("id"), F.lit(True).alias("area"), "x0", "y0", "x1", "y1"), outline.select(F.lit(0).cast("long").alias("poly_id"), "x0", "y0", "x1", "y1"))
    return spatial.polygons_of(edges.join(met.select(F.col("id").alias("bld_id")), "bld_id", "left_semi"))


def seeds_and_strip(spark: SparkSession, points: DataFrame, boxes: DataFrame, segments: DataFrame, boundary: DataFrame, c: float = 5.0, local: float = 500.0, pad: float = 10.0, frontage: float = 35.0, max_seed: float = 350.0, grow: float = 18.0, divider: float = 22.0, neighbourhood: float = 350.0, fill: float = 14.0, strip: float = 25.0, clamp: float = 140.0, n: int = 300) -> DataFrame:
    """points(pt_id, key, line_id, x, y): seeds by nearest building, grown along the street, with a strip; -> cells (key, cj, a, b).

    key is the section and has one line. The neighbourhood less the divider is taken whole, as it is one region
    unless points are far apart; of several regions the one nearest to the seeds' common centroid is taken.
    """
    points = materialise(spark, points.groupBy("key", "line_id", "x", "y").agg(F.min("pt_id").alias("pt_id")), "places")  # points of one place have one seed and one disc
    boxes = materialise(spark, boxes, "boxes")
    street, corridor, chosen = seed_layers(points, boxes, segments, local, pad, frontage, max_seed, n)
    seed = chosen.where("reason is null").join(points.select("pt_id", "key"), "pt_id").select("key", "bld_id").distinct().join(boxes, "bld_id")
    seed = materialise(spark, seed, "seed")
    grown = spatial.close_keys(corridor, seed, grow, "key").select("bld_id", F.array_sort(F.expr("transform(keys, k -> k.key)")).alias("keys"))
    grown = materialise(spark, grown.join(corridor, "bld_id"), "grown")
    side = cells.difference(cells.buffer_points(points, neighbourhood, c, "key"), cells.buffer_segments(street, divider, c, "key"), "key")
    regions = materialise(spark, cells.parts(spark, materialise(spark, side, "side")), "regions")
    measured = spatial.ring_measures(_edges(seed, "key").withColumn("poly_id", F.struct("key", "bld_id"))).select("poly_id.key", "area", "cx", "cy")
    centre = measured.groupBy("key").agg(F.expr("sum(area * cx) / sum(area)").alias("sx"), F.expr("sum(area * cy) / sum(area)").alias("sy"))
    near = f"greatest((a + 0.5e0) * {c} - sx, 0e0, sx - (b + 0.5e0) * {c})"
    gap = F.expr(f"{near} * {near} + ((cj + 0.5e0) * {c} - sy) * ((cj + 0.5e0) * {c} - sy)")
    best = regions.join(centre, "key").groupBy("key", "part").agg(F.min(gap).alias("d")).groupBy("key").agg(F.min_by("part", F.struct("d", "part")).alias("part"))
    side = materialise(spark, regions.join(best, ["key", "part"], "left_semi").drop("part"), "side")
    met = materialise(spark, _on_side(spark, grown, side, c), "met")
    houses = cells.merged(_runs(met.join(grown.drop("keys"), "bld_id"), fill, c, "keys").distinct().select(F.explode("keys").alias("key"), "cj", "a", "b"), "key")
    band = cells.intersect(cells.buffer_segments(street, strip, c, "key"), side, "key")
    shape = cells.intersect(cells.union(houses, band, "key"), cells.buffer_points(points, clamp, c, "key"), "key")
    shape = materialise(spark, cells.merged(cells.intersect(shape, cells.fill_rings(boundary, c)), "key"), "shape")
    return cells.largest_part(spark, shape)


def corridor_side(spark: SparkSession, points: DataFrame, boxes: DataFrame, segments: DataFrame, boundary: DataFrame, c: float = 5.0, near: float = 250.0, outer: float = 180.0, inner: float = 15.0, least_length: float = 20.0) -> DataFrame:
    """points(pt_id, key, line_id, x, y): buildings that meet the street's band on the side with most points; -> cells (key, cj, a, b).

    Of the line only the longest stretch within `near` of the points is taken, or the whole line where that is shorter than `least_length`.
    """
    of_line = points.select("line_id", "key").distinct()
    longest = spatial.near_points(points, segments, near).groupBy("line_id").agg(F.max_by(F.struct("a", "b"), F.struct(F.expr("b - a"), -F.col("a"))).alias("s")).select("line_id", "s.*").where(F.expr(f"b - a >= {least_length}"))
    street = spatial.cut(segments, longest).unionByName(segments.join(longest, "line_id", "left_anti").select("line_id", "seg_no", "x0", "y0", "x1", "y1", "m0")).join(of_line, "line_id")
    band = cells.difference(cells.buffer_segments(street, outer, c, "key"), cells.buffer_segments(street, inner, c, "key"), "key")
    regions = materialise(spark, cells.parts(spark, materialise(spark, band, "band")), "regions")
    at = points.selectExpr("pt_id", "key", f"cast(floor(x / {c}) as bigint) as ci", f"cast(floor(y / {c}) as bigint) as cj")
    counted = regions.join(at, ["key", "cj"]).where("ci between a and b").groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    held = regions.select("key", "part").distinct().join(counted, ["key", "part"], "left").fillna(0, "n")
    side = held.groupBy("key").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("part"))
    side = materialise(spark, regions.join(side, ["key", "part"], "left_semi").drop("part"), "side")
    held = materialise(spark, _buffer(boxes, 0.0, c, "bld_id"), "houses")
    found = cells.touching(held, side, ("key", "bld_id"))
    houses = cells.merged(held.join(found, "bld_id").select("key", "cj", "a", "b"), "key")
    return cells.merged(cells.intersect(houses, cells.fill_rings(boundary, c)), "key")
