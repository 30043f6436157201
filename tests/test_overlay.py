import itertools
import random

import pytest
from pyspark.sql import functions as F

from wardcraft.operators import assets, cells, graph, overlay, spatial
from wardcraft.operators.fill import filled
from wardcraft.operators.jts import Jts
from wardcraft.plans.lists import ranked, traced
from wardcraft.sources import osm, wkb


def _edges(spark, rings, key=lambda k: k, role=None):
    rows = [(key(k), k, *map(float, p), *map(float, q), bool(role and role[k])) for k, ring in enumerate(rings) for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return spark.createDataFrame(rows, "key long, ring long, x0 double, y0 double, x1 double, y1 double, hole boolean").repartition(3)


def _wkt(ring):
    return "POLYGON((" + ",".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "))"


def _read(spark, raw):
    return spark._jvm.org.locationtech.jts.io.WKBReader().read(bytearray(raw))


def _union(spark, j, shapes):
    items = spark._jvm.java.util.ArrayList()
    for s in shapes:
        items.add(s)
    return spark._jvm.org.locationtech.jts.operation.union.UnaryUnionOp(items).union()


BAD = {
    "bow-tie": [(0, 0), (10, 4), (10, 0), (0, 6)],
    "bow-tie, other way": [(0, 6), (10, 0), (10, 4), (0, 0)],
    "edge twice": [(0, 0), (4, 0), (4, 4), (8, 4), (4, 4), (4, 8), (0, 8)],
    "same corner twice": [(0, 0), (6, 0), (6, 6), (3, 3), (0, 6), (3, 3)],
    "spike": [(0, 0), (5, 0), (9, 0), (5, 0), (5, 5), (0, 5)],
    "loop inside": [(0, 0), (10, 0), (10, 10), (4, 10), (4, 4), (6, 4), (6, 6), (2, 6), (2, 10), (0, 10)],
    "good": [(0, 0), (3, 1), (2, 5)],
}


def test_repair_equals_jts(spark):
    """One key per bad ring; the other library repairs by a buffer of nothing."""
    j = Jts(spark)
    v = overlay.dissolved(spark, overlay.oriented(_edges(spark, list(BAD.values()))), snap=1e-9)
    got = {r.key: _read(spark, r.wkb) for r in overlay.shapes(v).collect()}
    for k, ring in enumerate(BAD.values()):
        want = j.repair(j.wkt(_wkt(ring)))
        assert got[k].isValid()
        assert got[k].symDifference(want).getArea() < 1e-6, list(BAD)[k]


def test_dissolve_equals_jts(spark):
    """Random polygons, also ones that share edges, lie in another or touch at a corner."""
    r, j = random.Random(4), Jts(spark)
    rings = []
    for _ in range(60):
        x, y = r.uniform(0, 60), r.uniform(0, 60)
        rings.append([(x, y), (x + r.uniform(3, 12), y + r.uniform(-2, 2)), (x + r.uniform(4, 9), y + r.uniform(4, 12))])
    rings += [[(100, 0), (110, 0), (110, 10), (100, 10)], [(110, 0), (120, 0), (120, 10), (110, 10)], [(102, 2), (104, 2), (104, 4), (102, 4)], [(120, 10), (130, 10), (130, 20), (120, 20)]]
    frame = [(200, 0), (230, 0), (230, 30), (200, 30)], [(205, 5), (225, 5), (225, 25), (205, 25)], [(210, 10), (215, 10), (215, 15), (210, 15)]
    rings += [*frame]
    holes = {len(rings) - 2}
    edges = overlay.oriented(_edges(spark, rings, key=lambda k: 7, role={k: k in holes for k in range(len(rings))}), F.col("hole")).drop("hole")
    found = overlay.shapes(overlay.dissolved(spark, edges)).collect()
    want = _union(spark, j, [j.wkt(_wkt(x)) for k, x in enumerate(rings) if k not in holes and x is not frame[0]] + [j.wkt(_wkt(frame[0])).difference(j.wkt(_wkt(frame[1])))])
    got = _read(spark, found[0].wkb)
    assert len(found) == 1 and got.isValid() and got.getNumGeometries() == want.getNumGeometries()
    assert got.symDifference(want).getArea() < 1e-3
    assert overlay.dissolved(spark, edges.limit(0)).count() == 0


def test_cell_rings_are_valid(spark):
    """Random cells: shapes that touch at corners, holes in holes, a hole that touches its shell."""
    r = random.Random(9)
    full = {(k, x, y) for k in range(4) for x in range(14) for y in range(10) if r.random() < (0.5, 0.6, 0.75, 0.9)[k]}
    full |= {(9, x, y) for x, y in itertools.product(range(3), range(3))} - {(9, 1, 1), (9, 2, 2)}
    full |= {(8, x, y) for x, y in itertools.product(range(7), range(7)) if max(abs(x - 3), abs(y - 3)) % 2 or (x, y) == (3, 3)}
    df = spark.createDataFrame([(k, y, x, x) for k, x, y in full], "key long, cj long, a long, b long").repartition(3)
    v = overlay.cell_rings(spark, cells.merged(df, "key"), 2.0)
    for row in overlay.shapes(v).collect():
        g = _read(spark, row.wkb)
        assert g.isValid() and g.getArea() == 4 * sum(k == row.key for k, _, _ in full)
        for x, y in itertools.product(range(-1, 15), range(-1, 11)):
            p = spark._jvm.org.locationtech.jts.geom.GeometryFactory().createPoint(spark._jvm.org.locationtech.jts.geom.Coordinate(2.0 * x + 1, 2.0 * y + 1))
            assert g.contains(p) == ((row.key, x, y) in full)


def test_lists_and_rings_are_ranked(spark):
    r = random.Random(2)
    ids = list(range(3000))
    r.shuffle(ids)
    lists = [ids[:2000], ids[2000:2001], ids[2001:2500]]
    ring = ids[2500:]
    links = [(a, b) for x in lists for a, b in zip(x, [*x[1:], None], strict=True)]
    both = spark.createDataFrame(links + list(zip(ring, [*ring[1:], ring[0]], strict=True)), "id long, next long").repartition(5)
    got = {r.id: (r.list, r.seq, r.n) for r in ranked(spark, both).collect()}
    assert got == {x: (items[-1], k, len(items)) for items in lists for k, x in enumerate(items)}
    rings = [ring, ids[:700], [5000]]
    df = spark.createDataFrame([(a, b) for x in rings for a, b in zip(x, [*x[1:], x[0]], strict=True)], "id long, next long").repartition(5)
    found = {r.id: r for r in traced(spark, df).collect()}
    for x in rings:
        k = x.index(min(x))
        assert [(found[i].ring, found[i].seq, found[i].n) for i in x[k:] + x[:k]] == [(min(x), s, len(x)) for s in range(len(x))]
    assert traced(spark, df.limit(0)).count() == 0 and ranked(spark, df.limit(0)).count() == 0


PIECE = "osmid long, pos int, u long, v long, oneway string, length double, x0 double, y0 double, x1 double, y1 double, name string"


def test_streets(spark):
    at = {k: (float(k), float(k % 3)) for k in range(20)}
    pieces = [(1, 0, 0, 1, None), (1, 1, 1, 2, None), (1, 2, 2, 3, None), (2, 0, 3, 4, "yes"), (2, 1, 4, 5, "Yes "), (3, 0, 6, 5, "-1"), (4, 0, 3, 2, None), (5, 0, 3, 7, "no"), (6, 0, 10, 11, "yes"), (6, 1, 11, 10, "yes"), (7, 0, 8, 8, None), (8, 0, None, 2, None)]
    df = spark.createDataFrame([(*p, 1.0, *at.get(p[2], (0.0, 0.0)), *at[p[3]], f"n{p[0]}") for p in pieces], PIECE)
    d = graph.directed(df)
    rows = d.collect()
    assert len({(r.u, r.v, r.key) for r in rows}) == len(rows) == 17
    assert {(r.u, r.v) for r in rows if r.osmid == 3} == {(5, 6)} and {(r.x0, r.x1) for r in rows if r.osmid == 3} == {(5.0, 6.0)}
    assert {(r.u, r.v, r.key) for r in rows if {r.u, r.v} == {2, 3}} == {(2, 3, 0), (2, 3, 1), (3, 2, 0), (3, 2, 1)}
    s = {(r.u, r.v): r for r in graph.simplified(spark, d).collect()}
    assert (s[0, 2].n_pieces, s[0, 2].length, s[0, 2].osmid, [p.x for p in s[0, 2].path]) == (2, 2.0, [1], [0.0, 1.0, 2.0])
    assert (s[3, 6].n_pieces, s[3, 6].osmid, s[3, 6].name) == (3, [2, 3], ["n2", "n3"]) and (6, 3) not in s
    assert (10, 11) in s and (11, 10) in s and s[8, 8].n_pieces == 1  # a ring without a crossing stays
    kept = graph.largest_component(spark, d).collect()
    assert {r.u for r in kept} | {r.v for r in kept} == set(range(8))
    inside = spark.createDataFrame([(4,), (99,)], "osmid long")
    assert {(r.u, r.v) for r in graph.truncated(d, inside).collect()} == {(3, 4), (4, 5)}


def test_street_layers(spark):
    """From pieces to the layers of streets and nodes: the largest component, chains as lines, streets counted at their ends."""
    at = {k: (float(k), float(k * k % 7)) for k in range(20)}
    pieces = [(1, 0, 0, 1, None), (1, 1, 1, 2, None), (2, 0, 2, 3, "yes"), (3, 0, 2, 4, None), (4, 0, 4, 5, None), (5, 0, 5, 2, None), (9, 0, 10, 11, None)]
    df = spark.createDataFrame([(*p, 1.0, *at[p[2]], *at[p[3]], None if p[0] == 3 else f"n{p[0]}") for p in pieces], PIECE).withColumn("roundabout", F.lit(False))
    edges = graph.street_graph(spark, df).cache()
    streets = {(r.u, r.v): r for r in assets.streets_layer(edges).collect()}
    assert set(streets) == {(0, 2), (2, 0), (2, 3), (2, 2)}
    assert (streets[0, 2].osmid, streets[0, 2].name, streets[0, 2].length_m, wkb.load(bytes(streets[0, 2].wkb))[:2]) == ("1", "n1", 2.0, ("LineString", [at[0], at[1], at[2]]))
    assert streets[2, 2].osmid in ("3,4,5", "5,4,3") and streets[2, 2].length_m == 3.0 and len({(r.u, r.v, r.key) for r in edges.collect()}) == edges.count() == 5
    nodes = {r.osmid: (r.x, r.y, r.street_count) for r in assets.nodes_layer(graph.graph_nodes(edges)).collect()}
    assert nodes == {0: (*at[0], 1), 2: (*at[2], 4), 3: (*at[3], 1)}
    whole = graph.street_graph(spark, df, simplify=False, retain_all=True)
    assert whole.count() == 13 and {r.osmid: r.street_count for r in graph.graph_nodes(whole).collect()}[2] == 4


@pytest.mark.parametrize("partitions", [1, 4])
def test_fill_over_ranges(spark, partitions):
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), k, float(k) if r.random() < 0.03 else None, "x") for k in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions * 3))
    try:
        df = spark.createDataFrame(rows, "key string, at long, v double, other string").repartition(5)
        got = {x.at: x.f for x in filled(df, "key", "at", "v", "f").collect()}
        last, want = {}, {}
        for key, at, v, _ in rows:
            last[key] = v if v is not None else last.get(key)
            want[at] = last[key]
        assert got == want
        assert filled(df.limit(0), "key", "at", "v", "f").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_large_building_among_small_ones(spark):
    """Rows of cells don't grow with the ratio of a building and the radius, and what was made of cells isn't sent to all tasks."""
    r = random.Random(3)
    boxes = [(k, x, y, x + r.uniform(2, 9), y + r.uniform(2, 9)) for k in range(300) for x, y in [(r.uniform(0, 900), r.uniform(0, 900))]] + [(999, 100.0, 100.0, 1100.0, 700.0)]
    points = [(k, r.uniform(0, 1100), r.uniform(0, 1100)) for k in range(200)]
    b = spark.createDataFrame(boxes, "bld_id long, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "pt_id long, x double, y double")
    near = spatial.within_radius(p, b, 0.5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    placed = spatial._own(b, spatial.BOX, 0.5).withColumnRenamed("own", "lv")
    assert spatial._cells(placed, spatial.BOX, 0.5).count() <= 4 * len(boxes)
    distance = lambda x, y, c: ((max(c[1] - x, 0, x - c[3])) ** 2 + max(c[2] - y, 0, y - c[4]) ** 2) ** 0.5
    for row in spatial.nearest(p, b, 60.0).collect():
        best = min((distance(row.x, row.y, c), c[0]) for c in boxes)
        assert row.bld_id == (best[1] if best[0] <= 60 else None)
    pairs = spatial.box_pairs(b, spatial.BOX, b.select(*[F.col(c).alias(f"{c}_") for c in b.columns]), tuple(f"{c}_" for c in spatial.BOX), 1.0)
    want = {(a[0], c[0]) for a in boxes for c in boxes if a[1] <= c[3] + 1 and a[3] >= c[1] - 1 and a[2] <= c[4] + 1 and a[4] >= c[2] - 1}
    got = [(x.bld_id, x.bld_id_) for x in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_inner_points_lie_inside(spark):
    j, r = Jts(spark), random.Random(6)
    star = lambda n: [(10 + s * c, 10 + s * d) for k in range(n) for s in [r.uniform(1, 9)] for c, d in [(__import__("math").cos(6.283 * k / n), __import__("math").sin(6.283 * k / n))]]
    shapes = [star(n) for n in range(3, 40)] + [[(0, 0), (10, 0), (10, 1), (1, 1), (1, 9), (10, 9), (10, 10), (0, 10)]]
    for ring in shapes:
        x, y = osm.inner_point([[[*ring, ring[0]]]])
        assert j.wkt(_wkt(ring)).contains(j.wkt(f"POINT({x} {y})"))
    holed = [[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (8, 1), (8, 8), (1, 8), (1, 1)]]
    x, y = osm.inner_point([holed, [[(20, 0), (20.5, 0), (20.5, 9), (20, 9), (20, 0)]]])
    assert (0 < x < 1 or 8 < x < 9) and 0 < y < 9
    assert osm.inner_point([[[(1, 1), (2, 1), (1, 1)]]]) == (1, 1)
    circle = [(k, (k * 37) % 11) for k in range(2000)]
    ways = [[circle[k], circle[(k + 1) % 2000]][:: r.choice((1, -1))] for k in range(2000)]
    r.shuffle(ways)
    assert [len(x) for x in osm.stitched([*ways, [(5000, 1), (5001, 1)]])] == [2001]


def test_stacked_boxes_take_few_lines(spark):
    """Boxes on each other: their lines along an axis are disjoint, and the running sums over tiles find what rays find."""
    r = random.Random(9)
    rings = [[(x, y), (x + 6, y), (x + 6, y + 4), (x, y + 4)] for x, y in ((r.randrange(12), r.randrange(8)) for _ in range(80))]
    rings += [[(r.randrange(30), r.randrange(30)) for _ in range(5)] for _ in range(12)]
    edges = overlay.oriented(_edges(spark, rings, key=lambda k: 0)).selectExpr("key", "x0 * 100 as px", "y0 * 100 as py", "x1 * 100 as qx", "y1 * 100 as qy", "cast(w as long) as n")
    summed = overlay._summed(edges.select(*overlay._up("key")))
    flat = sorted((x.ay, x.ax, x.bx) for x in summed.where("ay = by").collect())
    assert all(p[0] < q[0] or p[2] <= q[1] for p, q in itertools.pairwise(flat))
    lines = overlay.materialise(spark, overlay.noded(spark, summed).groupBy("key", "ax", "ay", "bx", "by").agg(F.sum("n").alias("n")).where("n <> 0"), "lines")
    rays, tiles = (sorted(map(tuple, t.select("ax", "ay", "bx", "by", "n", "d").collect())) for t in (overlay._right(lines), overlay._right_by_tiles(spark, lines)))
    assert rays == tiles and len(rays) > 200


def test_neighbours_of_lists_share_a_task(spark, monkeypatch):
    from wardcraft.plans import lists

    heads = []
    whole = lists.materialise
    monkeypatch.setattr(lists, "materialise", lambda s, df, name: (heads.append(df.where("len is not null").count()) if name == "chains" else None, whole(s, df, name))[1])
    links = spark.createDataFrame([(k, k + 1 if k % 50 != 49 else None) for k in range(1000)], "id long, next long").repartition(4, F.xxhash64("id"))
    got = {(r.id, r.list, r.seq, r.n) for r in ranked(spark, links).collect()}
    assert got == {(k, k // 50 * 50 + 49, k % 50, 50) for k in range(1000)} and heads[0] < 40
