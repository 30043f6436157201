import math

import pytest
from pyspark.sql import functions as F

from wardcraft.functions import crs
from wardcraft.operators import cells, polygons, spatial
from wardcraft.operators.jts import Jts
from wardcraft.plans.components import connected_components

SEGMENT = "line_id bigint, seq bigint, x double, y double"
BOX = "bld_id bigint, x0 double, y0 double, x1 double, y1 double"


def _line(spark, *points):
    return spatial.segments_of(spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(points)], SEGMENT))


def _points(spark, *points):
    return spark.createDataFrame([(k, 0, 0, float(x), float(y)) for k, (x, y) in enumerate(points)], "pt_id bigint, key bigint, line_id bigint, x double, y double")


def _ring(spark, *points):
    return spark.createDataFrame([(*map(float, p), *map(float, q)) for p, q in zip(points, [*points[1:], points[0]], strict=True)], "x0 double, y0 double, x1 double, y1 double")


def test_linear_reference(spark):
    line = _line(spark, (0, 0), (10, 0), (10, 10))
    got = {r.pt_id: r.m for r in spatial.measures(_points(spark, (4, 3), (12, 5), (-5, 0)), line).collect()}
    assert got == {0: 4.0, 1: 15.0, 2: 0.0}
    measured = spark.createDataFrame([(0, 5.0), (0, 15.0)], "line_id bigint, m double")
    xy = {r.i: (r.x, r.y) for r in spatial.samples(measured, line, 3, 0.0).collect()}
    assert xy == {0: (5.0, 0.0), 1: (10.0, 0.0), 2: (10.0, 5.0)}


@pytest.mark.parametrize("box,reason", [((10, -1, 12, 1), None), ((300, 300, 310, 310), "no_building_within_max_seed_dist"), ((1000, 0, 1001, 1), "no_hits_in_bbox")])
def test_nearest_and_reasons(spark, box, reason):
    boxes = spark.createDataFrame([(7, *map(float, box))], BOX)
    r = spatial.seeds(_points(spark, (0, 0)), boxes, boxes, 350.0).first()
    assert r.reason == reason and (reason or r.d == 10.0)
    if reason is None:
        assert spatial.seeds(_points(spark, (0, 0)), boxes, boxes.limit(0), 350.0).first().reason == "nearest_not_in_corridor (d=10.0m)"


def test_boxes_against_jts(spark):
    j = Jts(spark)
    line = "LINESTRING (0 0, 50 30, 90 10)"
    boxes = [(k, float(x), float(y), float(x + 7), float(y + 5)) for k, (x, y) in enumerate([(x, y) for x in range(-20, 110, 11) for y in range(-20, 60, 9)])]
    got = {r.bld_id for r in spatial.meeting(spark.createDataFrame(boxes, BOX), _line(spark, (0, 0), (50, 30), (90, 10)), 6.0).collect()}
    g = j.wkt(line)
    want = {b[0] for b in boxes if g.distance(j.wkt(f"POLYGON (({b[1]} {b[2]}, {b[3]} {b[2]}, {b[3]} {b[4]}, {b[1]} {b[4]}, {b[1]} {b[2]}))")) <= 6.0}
    assert got == want


def test_cell_areas_against_jts(spark):
    j = Jts(spark)
    line = _line(spark, (0, 0), (60, 40)).withColumn("key", F.lit(0))
    c = 1.0
    tube = cells.buffer_segments(line, 10.0, c, "key")
    disc = cells.buffer_points(_points(spark, (30, 20)), 20.0, c, "key")
    a, b = j.buffer(j.wkt("LINESTRING (0 0, 60 40)"), 10.0), j.buffer(j.wkt("POINT (30 20)"), 20.0)
    for got, want in ((tube, a), (cells.union(tube, disc), a.union(b)), (cells.intersect(tube, disc, "key"), a.intersection(b)), (cells.difference(tube, disc, "key"), a.difference(b))):
        assert abs(cells.area(got, c).first().area - want.getArea()) <= want.getLength() * c
    rest = cells.difference(tube, disc, "key")
    assert cells.parts(spark, rest).select("part").distinct().count() == j.parts(a.difference(b)).__len__() == 2


def _wkt(points):
    return "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*points, points[0]]) + "))"


def test_polygons_against_jts(spark):
    r = __import__("random").Random(9)
    j = Jts(spark)
    shapes = {}
    for k in range(40):
        cx, cy, n = r.uniform(0, 120), r.uniform(0, 80), r.randint(3, 8)
        shapes[k] = [(cx + r.uniform(2, 12) * math.cos(2 * math.pi * i / n), cy + r.uniform(2, 12) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    edges = spark.createDataFrame([(k, *p, *q) for k, s in shapes.items() for p, q in zip(s, [*s[1:], s[0]], strict=True)], "bld_id bigint, x0 double, y0 double, x1 double, y1 double")
    houses = spatial.polygons_of(edges)
    g = {k: j.wkt(_wkt(s)) for k, s in shapes.items()}
    points = [(r.uniform(0, 120), r.uniform(0, 80)) for _ in range(30)]
    for row in spatial.nearest(_points(spark, *points), houses, 25.0).collect():
        d = min((x.distance(j.wkt(f"POINT ({row.x} {row.y})")), k) for k, x in g.items())
        assert (row.bld_id is None and d[0] > 25) or (row.bld_id == d[1] and row.d == pytest.approx(d[0], abs=1e-9))
    line = [(0, 10), (60, 50), (110, 20)]
    got = {x.bld_id for x in spatial.meeting(houses, _line(spark, *line), 6.0).collect()}
    l = j.wkt("LINESTRING (" + ", ".join(f"{x} {y}" for x, y in line) + ")")  # noqa: E741
    assert got == {k for k, x in g.items() if x.distance(l) <= 6.0}
    got = {x.bld_id for x in spatial.grown(houses, houses.where("bld_id in (1, 2)"), 9.0).collect()}
    assert got == {k for k, x in g.items() if min(x.distance(g[1]), x.distance(g[2])) <= 9.0}
    for k in (3, 4):
        own = edges.where(F.col("bld_id") == k).withColumn("key", F.lit(0)).select("key", "bld_id", "x0", "y0", "x1", "y1")
        for radius in (0.0, 7.0):
            want = j.buffer(g[k], radius)
            assert abs(cells.area(cells.buffer_rings(own, radius, 0.5, "key"), 0.5).first().area - want.getArea()) <= want.getLength() * 0.5


def test_stretches_against_jts(spark):
    j = Jts(spark)
    line, points = [(0, 0), (100, 0), (100, 80), (20, 90)], [(10, 12), (30, -14), (95, 10), (60, 97)]
    wkt = j.wkt("LINESTRING (" + ", ".join(f"{x} {y}" for x, y in line) + ")")
    area = j.union([j.wkt(f"POINT ({x} {y})").buffer(15.0, 400) for x, y in points])
    want = sorted(p.getLength() for p in j.parts(wkt.intersection(area)))
    segments = _line(spark, *line)
    parts = spatial.near_points(_points(spark, *points), segments, 15.0)
    got = sorted(x.b - x.a for x in parts.collect())
    merged = [w for w in want if w > 1e-6]
    assert sum(got) == pytest.approx(sum(merged), rel=1e-3)
    cut = spatial.cut(segments, parts.orderBy(F.desc(F.expr("b - a"))).limit(1))
    assert cut.agg(F.sum(F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"))).first()[0] == pytest.approx(got[-1])


def _cells(df):
    return {(r.key, i, r.cj) for r in df.collect() for i in range(r.a, r.b + 1)}


def test_runs_against_plain_sets(spark):
    r = __import__("random").Random(1)
    points = [(r.uniform(0, 60), r.uniform(0, 40)) for _ in range(6)] + [(30.0, 20.0), (2.5, 2.5)]
    c, radius = 2.5, 12.5
    disc = cells.buffer_points(_points(spark, *points), radius, c, "key")
    centre = lambda i, k: ((i + 0.5) * c, (k + 0.5) * c)
    every = [(i, k) for i in range(-20, 60) for k in range(-20, 60)]
    want = {(0, i, k) for i, k in every if any((centre(i, k)[0] - x) ** 2 + (centre(i, k)[1] - y) ** 2 <= radius * radius for x, y in points)}
    assert _cells(disc) == want
    line = _line(spark, (0, 0), (30, 20), (30, 20), (60, 20), (60, 45)).withColumn("key", F.lit(0))
    tube = cells.buffer_segments(line, 5.0, c, "key")

    def away(px, py, a, b):
        q = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = 0 if not q else max(0, min(1, ((px - a[0]) * (b[0] - a[0]) + (py - a[1]) * (b[1] - a[1])) / q))
        return math.hypot(px - a[0] - t * (b[0] - a[0]), py - a[1] - t * (b[1] - a[1]))

    corners = [(0, 0), (30, 20), (30, 20), (60, 20), (60, 45)]
    near = {(0, i, k) for i, k in every if any(away(*centre(i, k), p, q) <= 5.0 for p, q in zip(corners, corners[1:], strict=False))}
    assert _cells(tube) == near
    box = cells.buffer_boxes(spark.createDataFrame([(0, 3.0, 4.0, 20.0, 9.0)], "key bigint, x0 double, y0 double, x1 double, y1 double"), 6.0, c, "key")
    boxed = {(0, i, k) for i, k in every if math.hypot(max(3 - centre(i, k)[0], 0, centre(i, k)[0] - 20), max(4 - centre(i, k)[1], 0, centre(i, k)[1] - 9)) <= 6.0}
    assert _cells(box) == boxed
    assert _cells(cells.union(tube, disc)) == near | want and _cells(cells.intersect(tube, disc, "key")) == near & want and _cells(cells.difference(tube, disc)) == near - want
    assert _cells(cells.intersect(tube, disc.drop("key"))) == near & want
    left = near - want
    found = cells.parts(spark, cells.difference(tube, disc)).collect()
    groups: dict[int, set] = {}
    for x in found:
        groups.setdefault(x.part, set()).update((0, i, x.cj) for i in range(x.a, x.b + 1))
    seen: set = set()
    plain = []
    for start in sorted(left):
        if start not in seen:
            todo, own = [start], {start}
            while todo:
                k, i, y = todo.pop()
                for n in ((k, i + 1, y), (k, i - 1, y), (k, i, y + 1), (k, i, y - 1)):
                    if n in left and n not in own:
                        own.add(n)
                        todo.append(n)
            seen |= own
            plain.append(own)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain)) and len(plain) > 1
    assert _cells(cells.largest_part(spark, cells.difference(tube, disc))) == max(plain, key=len)


def test_side_split_is_one_ring(spark):
    j = Jts(spark)
    sides = j.sides(j.wkt("LINESTRING (0 0, 300 0)"), 180.0, 15.0)
    assert len(sides) == 1 and sides[0].getNumInteriorRing() == 1
    assert j.project(j.wkt("LINESTRING (0 0, 10 0, 10 10)"), 12, 5) == 15.0 and j.interpolate(j.wkt("LINESTRING (0 0, 10 0, 10 10)"), 15) == (10.0, 5.0)


def test_polygons_run_on_toy_data(spark):
    points = _points(spark, (0, 20), (60, 25), (150, -20), (300, 22))
    line, bound = _line(spark, (-50, 0), (350, 0)), _ring(spark, (-500, -500), (900, -500), (900, 500), (-500, 500))
    boxes = spark.createDataFrame([(1, 0.0, 24.0, 20.0, 34.0), (2, 55.0, 25.0, 70.0, 40.0), (3, 140.0, -40.0, 160.0, -25.0), (4, 500.0, 400.0, 510.0, 410.0)], BOX)
    v3 = polygons.seeds_and_strip(spark, points, boxes, line, bound)
    v1 = polygons.corridor_side(spark, points, boxes, line, bound)
    assert v3.count() > 0 and cells.area(v1, 5.0).first().area == pytest.approx(20 * 10 + 15 * 15 + 20 * 15, rel=0.2)


def test_projections(spark):
    df = spark.createDataFrame([(25.0, 46.0), (26.1, 44.43), (0.0, 0.0), (180.0, 0.0)], "lon double, lat double")
    x, y = crs.transform(F.col("lon"), F.col("lat"), 4326, 3857)
    r = df.select(x.alias("x"), y.alias("y")).collect()
    assert abs(r[3].x - 20037508.3428) < 1e-3 and abs(r[2].x) + abs(r[2].y) < 1e-6
    d = df.limit(2)
    x, y = crs.transform(F.col("lon"), F.col("lat"), 4326, 3844)
    d = d.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = crs.transform(F.col("x"), F.col("y"), 3844, 4326)
    rows = d.select("lon", "lat", "x", "y", lon.alias("l2"), lat.alias("b2")).collect()
    assert abs(rows[0].x - 500000) < 1e-6 and abs(rows[0].y - 500000) < 1e-6
    assert all(math.hypot(r.l2 - r.lon, r.b2 - r.lat) * 111_000 < 1e-3 for r in rows)
    assert crs.is_geographic(4326) and not crs.is_geographic(3844)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (200, 100)]
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100, 200: 100}
    assert connected_components(spark, spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_points_of_one_place_meet_boxes_once(spark, monkeypatch):
    met = []
    whole = spatial.within_radius
    monkeypatch.setattr(spatial, "within_radius", lambda points, *a: (met.append(points.count()), whole(points, *a))[1])
    points = _points(spark, *[(k % 2 * 50, 0) for k in range(40)])
    boxes = spark.createDataFrame([(k, 3.0, 0.0, 4.0, 1.0) for k in (9, 5, 7)], BOX)
    got = {r.pt_id: (r.n_square, r.bld_id, r.d) for r in spatial.nearest(points, boxes, 10.0).collect()}
    assert met == [2] and got == {k: (0, None, None) if k % 2 else (3, 5, 3.0) for k in range(40)}


def test_cells_of_many_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SHARE", 10)
    small = spark.range(300).selectExpr("id as a", "cast(id % 40 as double) as ax0", "cast(id % 7 as double) as ay0", "id % 40 + 0.5d as ax1", "id % 7 + 0.5d as ay1")
    large = spark.createDataFrame([(k, 5.0 * k, 0.0, 5.0 * k + 9, 20.0) for k in range(4)], "b long, bx0 double, by0 double, bx1 double, by1 double")
    assert spatial._shares({0: 300}, {4: 4}) == {0: (30, 1), 4: (30, 1)}
    got = spatial.box_pairs(small, ("ax0", "ay0", "ax1", "ay1"), large, ("bx0", "by0", "bx1", "by1"), 1.0).select("a", "b").collect()
    want = small.crossJoin(large).where("ax0 <= bx1 + 1 and ax1 >= bx0 - 1 and ay0 <= by1 + 1 and ay1 >= by0 - 1").select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_shapes_with_corners_in_one_cell_are_not_measured(spark, monkeypatch):
    met = []
    pairs = spatial.box_pairs
    monkeypatch.setattr(spatial, "box_pairs", lambda a, *r: (met.append(a.count()), pairs(a, *r))[1])
    boxes = spark.createDataFrame([(k, k % 30 * 1.0, k % 11 * 1.0, k % 30 + 1.0, k % 11 + 1.0) for k in range(330)] + [(1000, 70.0, 0.0, 71.0, 1.0), (1001, 36.0, 0.0, 37.0, 1.0)], BOX)
    got = {r.bld_id for r in spatial.grown(boxes, boxes.where("bld_id < 330"), 6.0).collect()}
    assert got == {*range(330), 1001} and met[0] == 2
