"""Far more shapes than there are places: work per shape doesn't grow with what is near it, and results stay those of all pairs."""

import random

from pyspark.sql import functions as F

from wardcraft.operators import cells, spatial

BOX = "bld_id bigint, x0 double, y0 double, x1 double, y1 double"


def _boxes(n, seed):
    rnd = random.Random(seed)
    corners = [(rnd.uniform(0, 300), rnd.uniform(0, 100)) for _ in range(n)]
    return [(i, x, y, x + rnd.uniform(1, 17), y + rnd.uniform(1, 13)) for i, (x, y) in enumerate(corners)]


def _edges(boxes):
    """The boxes without one corner, as rings."""
    rows = []
    for i, x0, y0, x1, y1 in boxes:
        ring = [(x0, y0), (x1 - 0.5, y0), (x1, y0 + 0.5), (x1, y1), (x0, y1)]
        rows += [(i, *p, *q) for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return rows


def _gap(a, b):
    return max(b[0] - a[2], a[0] - b[2], 0.0), max(b[1] - a[3], a[1] - b[3], 0.0)


def test_corridor_measures_few_pairs(spark, monkeypatch):
    """A street of many short pieces along y = 50: boxes well within its corridor meet none of them one by one."""
    measured = []
    plain = spatial._segment_box
    monkeypatch.setattr(spatial, "_segment_box", lambda pairs, s, b: measured.append(pairs.count()) or plain(pairs, s, b))
    boxes = _boxes(5000, 1)
    street = spatial.segments_of(spark.createDataFrame([(0, k, float(k), 50.0) for k in range(301)], "line_id bigint, seq int, x double, y double"))
    want = {i for i, x0, y0, x1, y1 in boxes if max(50 - y1, y0 - 50, 0) ** 2 + max(x0 - 300, 0) ** 2 <= 900}
    assert {r.bld_id for r in spatial.meeting(spark.createDataFrame(boxes, BOX), street, 30.0).collect()} == want
    assert sum(measured) < 60_000  # all boxes by the pieces near each are above 200,000


def test_close_keys_of_all_pairs(spark):
    boxes = _boxes(400, 2)
    seeds = [(b, k) for b in boxes for k in range(3) if (b[0] * 7 + k) % 41 == 0]
    table = spark.createDataFrame([(k, *b) for b, k in seeds], f"key bigint, {BOX}")
    found = spatial.close_keys(spark.createDataFrame(boxes, BOX), table, 18.0, "key")
    got = {(r.bld_id, k.key) for r in found.collect() for k in r["keys"]}
    near = lambda a, b: sum(g * g for g in _gap(a, b)) <= 18.0**2
    assert got == {(c[0], k) for c in boxes for s, k in seeds if near(c[1:], s[1:])}


def test_runs_of_polygons_without_a_shuffle(spark):
    edges = spark.createDataFrame(_edges(_boxes(60, 3)), BOX)
    whole = lambda df: {(r.bld_id, r.cj, i) for r in df.collect() for i in range(r.a, r.b + 1)}
    filled = cells.fill_polygons(spatial.polygons_of(edges), 2.0, "bld_id")
    assert whole(filled) == whole(cells.fill_rings(edges, 2.0, "bld_id"))
    wide = cells.buffer_segments(edges, 6.0, 2.0, "bld_id", merge=False)
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    assert whole(wide) == whole(cells.buffer_segments(edges, 6.0, 2.0, "bld_id"))
    one = edges.where("bld_id = 5").collect()
    d = lambda x, y, e: _segment(x, y, e.x0, e.y0, e.x1, e.y1)
    want = {(5, j, i) for i in range(-10, 180) for j in range(-10, 80) if min(d((i + 0.5) * 2, (j + 0.5) * 2, e) for e in one) <= 36.0}
    assert whole(wide.where(F.col("bld_id") == 5)) == want


def _segment(x, y, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    t = max(0.0, min(1.0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy)))
    return (x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2
