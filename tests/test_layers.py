import math

import pytest
from pyspark.sql import functions as F

from wardcraft.functions import crs
from wardcraft.operators import assets, cells, polygons, spatial
from wardcraft.operators.jts import Jts
from wardcraft.plans.views import view
from wardcraft.sources import wkb


def _read(spark, raw):
    return spark._jvm.org.locationtech.jts.io.WKBReader().read(bytearray(raw))


def _square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def test_boundary_is_one_repaired_shape(spark):
    """Two parts that overlap, one with a hole, one bow-tie, a line, a null: one row, and its edges clip."""
    rows = [("a", wkb.dump("Polygon", [_square(0, 0, 10), _square(2, 2, 3)])), ("b", wkb.dump("MultiPolygon", [[_square(8, 0, 10)], [_square(40, 0, 5)]])), ("c", wkb.dump("Polygon", [[(60, 0), (70, 4), (70, 0), (60, 6), (60, 0)]])), ("d", wkb.dump("LineString", [(0, 0), (99, 99)])), ("e", None)]
    layer, edges = polygons.boundary(spark, spark.createDataFrame(rows, "id string, wkb binary"), "X", "file")
    row = layer.collect()
    j = Jts(spark)
    want = j.union([_read(spark, rows[0][1]).union(_read(spark, rows[1][1])), j.repair(_read(spark, rows[2][1]))])
    got = _read(spark, row[0].wkb)
    assert len(row) == 1 and (row[0].name, row[0].source) == ("X", "file") and got.isValid()
    assert got.symDifference(want).getArea() < 1e-4 and got.getNumGeometries() == 3
    assert cells.area(cells.fill_rings(edges, 0.5).withColumn("key", F.lit(1)), 0.5, "key").first().area == pytest.approx(got.getArea(), abs=3)


def test_buildings_within_an_outline(spark):
    shapes = [(1, _square(1, 1, 2)), (2, _square(9, 9, 3)), (3, _square(30, 30, 2)), (4, _square(-50, -50, 200)), (5, _square(10, 0, 2))]
    b = spark.createDataFrame([(k, wkb.dump("Polygon", [r])) for k, r in shapes], "bld_id long, wkb binary")
    ring = _square(0, 0, 10)
    outline = spark.createDataFrame([(*map(float, p), *map(float, q)) for p, q in zip(ring, ring[1:], strict=False)], "x0 double, y0 double, x1 double, y1 double")
    got = polygons.buildings_within(b, outline)
    assert sorted(r.bld_id for r in got.collect()) == [1, 2, 4, 5]
    moved = polygons.buildings_within(b, outline, lambda x, y: (x + 28, y + 28)).collect()
    assert {r.bld_id for r in moved} == {4} and {r.x0 for r in moved} == {-22.0}


def test_shape_layers(spark, small):
    """The layer of the first recipe's shapes: valid, with the cells' area; the points with and without a seed."""
    points = view(spark, small, "v_pt").where("pt_id < 60")
    lines = spatial.segments_of(view(spark, small, "v_vert"))
    corners = [(0.0, 0.0), (950.0, 0.0), (900.0, 390.0), (0.0, 390.0)]
    edge = spark.createDataFrame([(*p, *q) for p, q in zip(corners, [*corners[1:], corners[0]], strict=True)], "x0 double, y0 double, x1 double, y1 double")
    houses = spatial.polygons_of(view(spark, small, "v_bedge"))
    shape = polygons.corridor_side(spark, points, houses, lines, edge).cache()
    named = spark.createDataFrame([(k, f"street {k}") for k in range(5)], "key long, street string")
    layer = polygons.layer(spark, shape, 5.0, named)
    assert layer.columns == ["sv", "street", "wkb"]
    areas = {r.key: r.area for r in cells.area(shape, 5.0, "key").collect()}
    for r in layer.collect():
        g = _read(spark, r.wkb)
        assert g.isValid() and g.getArea() == areas.pop(r.sv)
    assert not areas
    by_seeds = polygons.layer(spark, shape, 5.0, named, polygons.METHOD, frontage_dist=35.0, max_seed_dist=350.0, grow_m=18.0, fill_m=14.0, strip_depth=25.0)
    assert by_seeds.columns == ["sv", "street", "method", "frontage_dist", "max_seed_dist", "grow_m", "fill_m", "strip_depth", "wkb"]
    _, _, chosen = polygons.seed_layers(points, houses, lines, n=40)
    seeds, failed = polygons.debug_layers(points, chosen)
    assert seeds.columns == ["pt_id", "best_d", "x", "y"] and failed.columns == ["pt_id", "reason", "x", "y"]
    assert seeds.count() + failed.count() == points.count()
    with pytest.raises(ValueError, match="no part of a street"):
        polygons.seed_layers(points.withColumn("x", F.col("x") + 1e6), houses, lines)
    with pytest.raises(ValueError, match="no building"):
        polygons.seed_layers(points, houses.limit(0), lines)


def test_boundary_pick_has_exact_types(spark):
    rows = [(1, "Boundary line", "LineString"), (2, "parts", "Polygon"), (3, "old BOUNDARY", "MultiPolygon"), (4, "boundary z", "Polygon Z")]
    layers = spark.createDataFrame(rows, "ord long, name string, geom_type string")
    assert assets.boundary_layer_name(layers) == assets.pick_boundary_layer(layers).first().name == "old BOUNDARY"
    assert assets.boundary_layer_name(layers.where("ord < 3")) == "parts"
    with pytest.raises(ValueError):
        assets.boundary_layer_name(layers.where("ord = 4"))
    with pytest.raises(Exception, match="no polygon layer"):
        assets.pick_boundary_layer(layers.where("ord in (1, 4)")).collect()


def test_datum_shift(spark):
    """Against the same transformation by plain arithmetic, there and back within a few millimetres, as heights are left out; 100 to 250 m from the result without it."""
    places = [(26.1025, 44.4268), (25.0, 46.0), (21.2, 45.75), (28.6, 44.17), (23.6, 46.77)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "k int, x double, y double")
    there = assets.reprojected(df, 4326, 3844)
    assert there.columns == df.columns
    back = {r.k: (r.x, r.y) for r in assets.reprojected(there, 3844, 4326).collect()}
    web = {r.k: (r.x, r.y) for r in assets.reprojected(assets.reprojected(df, 4326, 3857), 3857, 3844).collect()}
    x, y = crs.transform(F.col("x"), F.col("y"), 4326, 3844)
    plain = {r.k: (r.x, r.y) for r in df.select("k", x.alias("x"), y.alias("y")).collect()}
    for r in there.collect():
        assert back[r.k] == pytest.approx(places[r.k], abs=5e-8) and web[r.k] == pytest.approx((r.x, r.y), abs=1e-5)
        assert 100 < math.dist((r.x, r.y), plain[r.k]) < 250
    x, y = crs.from_3844(F.col("x"), F.col("y"))
    for r in there.select("k", x.alias("x"), y.alias("y")).collect():  # degrees of the other datum, shifted by hand
        a, e2 = crs.A, 2 / crs.F_INV - 1 / crs.F_INV**2
        s, c, lo = math.sin(math.radians(r.y)), math.cos(math.radians(r.y)), math.radians(r.x)
        n = a / math.sqrt(1 - e2 * s * s)
        p = (n * c * math.cos(lo), n * c * math.sin(lo), n * (1 - e2) * s)
        dx, dy, dz, rx, ry, rz, ds = crs.SHIFT
        rx, ry, rz, k = *(math.radians(v / 3600) for v in (rx, ry, rz)), 1 + ds / 1e6
        q = (dx + k * (p[0] - rz * p[1] + ry * p[2]), dy + k * (rz * p[0] + p[1] - rx * p[2]), dz + k * (-ry * p[0] + rx * p[1] + p[2]))
        a, f = crs.WGS84
        e2, flat = 2 / f - 1 / f**2, math.hypot(q[0], q[1])
        lat = math.atan2(q[2], flat)
        for _ in range(20):
            lat = math.atan2(q[2] + e2 * a / math.sqrt(1 - e2 * math.sin(lat) ** 2) * math.sin(lat), flat)
        assert (math.degrees(math.atan2(q[1], q[0])), math.degrees(lat)) == pytest.approx(places[r.k], abs=5e-8)
