"""Map features and street graphs from extract files (Overpass JSON elements, one per line), in place of network calls."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.operators.graph import directed
from wardcraft.sources import wkb

#: Mean radius of the earth in metres. Fixed value.
MEAN_RADIUS = 6371009.0
ELEMENT = "type string, id bigint, lat double, lon double, nodes array<bigint>, geometry array<struct<lat:double,lon:double>>, members array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>, tags map<string,string>"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements with a fixed schema, so that nothing is read twice to infer one."""
    return spark.read.schema(ELEMENT).json(path)


def stitched(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from ways that meet end to end, each way met by its ends; what doesn't close is left out."""
    left = {k: list(w) for k, w in enumerate(ways) if len(w) > 1}
    at: dict[tuple[float, float], list[int]] = {}
    for k, w in left.items():
        for end in (w[0], w[-1]):
            at.setdefault(end, []).append(k)
    rings = []
    for k in sorted(left, reverse=True):
        if k not in left:
            continue
        ring = left.pop(k)
        while ring[0] != ring[-1]:
            ends = at[ring[-1]]
            while ends and ends[-1] not in left:
                ends.pop()
            if not ends:
                break
            w = left.pop(ends.pop())
            ring += (w if w[0] == ring[-1] else w[::-1])[1:]
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append(ring)
    return rings


def _crossings(rings: list[list[tuple[float, float]]], y: float) -> list[float]:
    return sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for r in rings for (x0, y0), (x1, y1) in zip(r, r[1:], strict=False) if (y0 > y) != (y1 > y))


def inner_point(parts: list[list[list[tuple[float, float]]]]) -> tuple[float, float]:
    """A point inside polygons, each its rings: the middle of the widest stretch that a line through one of them has.

    A part's line lies between the two heights of vertices next to its half height, so it passes through no vertex and always meets the inside.
    A part without height gives a vertex, as nothing is inside.
    """
    widest = None
    for rings in parts:
        heights = sorted({y for r in rings for _, y in r})
        if len(heights) < 2:
            continue
        middle = (heights[0] + heights[-1]) / 2
        above = next(k for k, y in enumerate(heights) if y > middle)
        y = (heights[above - 1] + heights[above]) / 2
        xs = _crossings(rings, y)
        for a, b in zip(xs[::2], xs[1::2], strict=False):
            if widest is None or b - a > widest[0]:
                widest = (b - a, (a + b) / 2, y)
    return widest[1:] if widest else parts[0][0][0]


def _shape(kind: str, lat: float, lon: float, geometry, members):
    """(geometry type, place, WKB) of an element; a relation is a multipolygon of its stitched ways, holes by the ring that holds them."""
    path = lambda g: [(p["lon"], p["lat"]) for p in g or [] if p]
    if kind == "node":
        return "Point", (lon, lat), wkb.dump("Point", (lon, lat))
    if kind == "way":
        ring = path(geometry)
        if len(ring) > 3 and ring[0] == ring[-1]:
            return "Polygon", inner_point([[ring]]), wkb.dump("Polygon", [ring])
        return "LineString", ring[len(ring) // 2] if ring else (None, None), wkb.dump("LineString", ring) if ring else None
    outer = stitched([path(m["geometry"]) for m in members or [] if m["role"] != "inner"])
    if not outer:
        return "GeometryCollection", (None, None), None
    parts = [[r] for r in outer]
    for hole in stitched([path(m["geometry"]) for m in members if m["role"] == "inner"]):
        x, y = inner_point([[hole]])
        home = next((p for p in parts if sum(c > x for c in _crossings(p[:1], y)) % 2), parts[0])
        home.append(hole)
    return "MultiPolygon", inner_point(parts), wkb.dump("MultiPolygon", parts)


_FEATURE = "etype string, osmid bigint, geom_type string, x double, y double, tags map<string,string>, wkb binary"


def _features(batches):
    for batch in batches:
        columns = [batch.column(c) for c in ("type", "lat", "lon", "geometry", "members")]
        shapes = [_shape(*(c[k].as_py() for c in columns)) for k in range(batch.num_rows)]  # one shape in Python at a time
        cols = [batch.column("type"), batch.column("id"), pa.array([s[0] for s in shapes], pa.string()), *[pa.array([s[1][k] for s in shapes], pa.float64()) for k in (0, 1)], batch.column("tags"), pa.array([s[2] for s in shapes], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["etype", "osmid", "geom_type", "x", "y", "tags", "wkb"])


def tagged_features(elements: DataFrame, tag: str) -> DataFrame:
    """etype, osmid, geom_type, x, y, tags, wkb of elements with the tag: nodes are points, closed ways polygons, relations multipolygons; x, y is a point inside."""
    rows = elements.where(F.col("tags").getItem(tag).isNotNull()).select("type", "id", "lat", "lon", "geometry", "members", "tags")
    return rows.mapInArrow(_features, _FEATURE)


def great_circle(lon0, lat0, lon1, lat1):
    """Metres between two places in degrees, on the sphere of the mean radius."""
    a, b = F.radians(lat0), F.radians(lat1)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * MEAN_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def street_pieces(elements: DataFrame) -> DataFrame:
    """osmid, pos, u, v, name, highway, oneway, roundabout, x0, y0, x1, y1, length in metres: a row per pair of neighbouring nodes of a way tagged highway."""
    ways = elements.where((F.col("type") == "way") & F.col("tags").getItem("highway").isNotNull())
    pairs = ways.select("id", "tags", F.posexplode(F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(nodes[i - 1] as u, nodes[i] as v, geometry[i - 1] as a, geometry[i] as b))")).alias("pos", "e")).where("e.u is not null")
    tag = lambda k: F.col("tags").getItem(k).alias(k)
    round_ = F.coalesce(F.col("tags").getItem("junction") == "roundabout", F.lit(False)).alias("roundabout")
    return pairs.select(F.col("id").alias("osmid"), "pos", "e.u", "e.v", tag("name"), tag("highway"), tag("oneway"), round_, F.col("e.a.lon").alias("x0"), F.col("e.a.lat").alias("y0"), F.col("e.b.lon").alias("x1"), F.col("e.b.lat").alias("y1"), great_circle(F.col("e.a.lon"), F.col("e.a.lat"), F.col("e.b.lon"), F.col("e.b.lat")).alias("length"))


def street_edges(elements: DataFrame) -> DataFrame:
    """The directed multigraph of street_pieces: u, v, key, reversed, osmid and their other columns; (u, v, key) is unique."""
    return directed(street_pieces(elements), F.col("roundabout"))


def street_nodes(edges: DataFrame) -> DataFrame:
    """osmid, x, y, street_count of the edges' ends; both ways of a street count once."""
    ends = edges.where(~F.col("reversed") | (F.lower("oneway").isin("-1", "reverse"))) if "reversed" in edges.columns else edges
    ends = ends.select(F.explode(F.array(F.struct(F.col("u").alias("osmid"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("v").alias("osmid"), F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("n"))
    return ends.select("n.*").groupBy("osmid").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.count(F.lit(1)).cast("int").alias("street_count"))
