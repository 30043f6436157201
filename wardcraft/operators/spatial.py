"""Spatial operators. Pairs come together by equality of a grid cell, a line or a group, never by comparing all with all.

Tables: points(pt_id, x, y), boxes(bld_id, x0, y0, x1, y1), segments(line_id, seg_no, x0, y0, x1, y1, m0). Boxes that have a
column edges (see `polygons_of`) are the bounds of polygons: then the bounds bring pairs together, and all distances are those of the polygons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardcraft.functions.geometry import box_box, crosses_ray, inside, param, point_box, point_polygon, point_segment, segment_segment
from wardcraft.operators.cells import buffer_boxes, buffer_rings, buffer_segments, held
from wardcraft.plans.shared import materialise

POINT, BOX, SEGMENT = ("x", "y"), ("x0", "y0", "x1", "y1"), ("x0", "y0", "x1", "y1")
_EDGE = ("e.x0", "e.y0", "e.x1", "e.y1")


def segments_of(vertices: DataFrame) -> DataFrame:
    """vertices(line_id, seq, x, y) -> segments with m0, the length before each. A line's vertices stay in one window, as a line has few."""
    w = Window.partitionBy("line_id").orderBy("seq")
    ends = vertices.select("line_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")
    length = F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))")
    w = Window.partitionBy("line_id").orderBy("seq")
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return ends.select("line_id", (F.row_number().over(w) - 1).alias("seg_no"), "x0", "y0", "x1", "y1", before.alias("m0"))


#: Sizes of shapes count as this much at least.
TINY = 2.0**-20


def level(extent: str) -> str:
    """The power of two that is the extent or the next above it: cells of that size, of which a shape of the extent touches two a side at most."""
    return f"cast(ceil(log2(greatest({extent}, {TINY}))) as int)"


def _own(df: DataFrame, box: tuple[str, ...], pad: float) -> DataFrame:
    x0, y0, x1, y1 = box
    return df.withColumn("own", F.expr(level(f"greatest({x1} - {x0}, {y1} - {y0}) + {2 * pad}")))


def _level_rows(table: DataFrame) -> dict[int, int]:
    """The levels that shapes have, with their rows: a row per power of two, so few."""
    return {r.own: r["count"] for r in table.groupBy("own").count().collect() if r.own is not None}


def _levels(table: DataFrame) -> list[int]:
    return sorted(_level_rows(table))


def _cells(df: DataFrame, box: tuple[str, ...], pad: float) -> DataFrame:
    """A row for each cell (ci, cj) of size 2 ** lv that the box, grown by pad, touches."""
    x0, y0, x1, y1 = box
    span = lambda a, b: f"sequence(cast(floor(({a} - {pad}) / pow(2e0, lv)) as bigint), cast(floor(({b} + {pad}) / pow(2e0, lv)) as bigint))"
    return df.withColumn("ci", F.explode(F.expr(span(x0, x1)))).withColumn("cj", F.explode(F.expr(span(y0, y1))))


def _upwards(df: DataFrame, others: list[int]) -> DataFrame:
    """Each row at its own level, and at the coarser ones that the other table has."""
    coarser = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("own"))
    return df.withColumn("lv", F.explode(F.concat(F.array("own"), coarser)))


#: Rows of a level beyond this are dealt out to more tasks than there are cells.
SHARE = 200_000


def _shares(own: dict[int, int], others: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Rows by their own level of two tables -> level: (shares of the first, of the second). Where one has far more rows than the other at a level, they
    are dealt out and the few of the other go to every share, which adds at most as many rows as there are."""
    found = {}
    for lv in own.keys() | others.keys():
        a, b = (max(1, sum(n for k, n in t.items() if k <= lv)) for t in (own, others))
        n = min(-(-max(a, b) // SHARE), max(a, b) // min(a, b))
        found[lv] = (n, 1) if a >= b else (1, n)
    return found


def _dealt(df: DataFrame, shares: dict[int, int], others: dict[int, int]) -> DataFrame:
    """Rows with lv -> with share: one of their level's shares, by the row's values, or all of the other table's."""
    if max([1, *shares.values(), *others.values()]) == 1:
        return df.withColumn("share", F.lit(0))
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "null", "variant")]
    of = lambda m: "case lv " + " ".join(f"when {k} then {v}" for k, v in m.items()) + " else 1 end"
    one = f"array(cast(pmod(xxhash64({', '.join(f'`{c}`' for c in plain)}), {of(shares)}) as int))"
    return df.withColumn("share", F.explode(F.expr(f"case when {of(others)} > 1 then sequence(0, {of(others)} - 1) else {one} end")))


def box_pairs(a: DataFrame, a_box: tuple[str, ...], b: DataFrame, b_box: tuple[str, ...], pad: float, *on: str) -> DataFrame:
    """Rows of a and b, columns apart but for `on`, which has to be equal, whose boxes are within pad of each other on both axes; each pair once.

    Shapes stand in cells as large as themselves, and a pair meets at the level of the larger one, so rows don't grow with the ratio of a
    shape and a radius. Cells are met by sorting: what was made of cells is never sent to all tasks. A cell of many rows on one side and few on the other is met in shares.
    """
    left, right = _own(a, a_box, 0.0), _own(b, b_box, pad)
    rows, more = _level_rows(left), _level_rows(right)
    shares = _shares(rows, more)
    of = [{lv: n[k] for lv, n in shares.items()} for k in (0, 1)]
    left, right = _dealt(_upwards(left, sorted(more)), of[0], of[1]), _dealt(_upwards(right, sorted(rows)), of[1], of[0])
    left, right = _cells(left, a_box, 0.0), _cells(right.withColumnRenamed("own", "own_b"), b_box, pad)
    first = lambda p, q, c: f"{c} = greatest(floor({p} / pow(2e0, lv)), floor(({q} - {pad}) / pow(2e0, lv)))"
    once = f"lv = greatest(own, own_b) and {first(a_box[0], b_box[0], 'ci')} and {first(a_box[1], b_box[1], 'cj')}"
    near = " and ".join(f"{a_box[k]} <= {b_box[k + 2]} + {pad} and {a_box[k + 2]} >= {b_box[k]} - {pad}" for k in (0, 1))
    return left.hint("merge").join(right, [*on, "lv", "ci", "cj", "share"]).where(once).where(near).drop("lv", "ci", "cj", "share", "own", "own_b")


def polygons_of(edges: DataFrame) -> DataFrame:
    """edges(bld_id, x0, y0, x1, y1) of all rings -> boxes with edges, an array. A building has few edges; for large outlines there is `points_in_polygons`."""
    x, y = (F.min(F.least(f"{c}0", f"{c}1")) for c in "xy")
    x1, y1 = (F.max(F.greatest(f"{c}0", f"{c}1")) for c in "xy")
    return edges.groupBy("bld_id").agg(x.alias("x0"), y.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.array_sort(F.collect_list(F.struct(*SEGMENT))).alias("edges"))


def _shape(boxes: DataFrame) -> list[str]:
    """The columns of a box, or of a polygon."""
    return [*BOX, *(["edges"] if "edges" in boxes.columns else [])]


def within_radius(points: DataFrame, boxes: DataFrame, radius: float) -> DataFrame:
    """pt_id, x, y, bld_id, d, hit: boxes whose bounds meet the square of the radius round a point; hit: the box is truly within it.

    A box stands in the up to four cells as large as its grown self, a point in one cell of every size that boxes have, so each pair meets once.
    """
    placed = _own(boxes, BOX, radius)
    levels = _levels(placed)
    at = points.withColumn("lv", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    at = at.withColumns({"ci": F.expr("cast(floor(x / pow(2e0, lv)) as bigint)"), "cj": F.expr("cast(floor(y / pow(2e0, lv)) as bigint)")})
    near = at.hint("merge").join(_cells(placed.withColumnRenamed("own", "lv"), BOX, radius), ["lv", "ci", "cj"]).drop("lv")
    square = f"x0 <= x + {radius} AND x1 >= x - {radius} AND y0 <= y + {radius} AND y1 >= y - {radius}"
    d = point_polygon(*POINT, "edges") if "edges" in boxes.columns else point_box(*POINT, *BOX)
    return near.where(square).withColumn("d", F.expr(d)).withColumn("hit", F.col("d") <= radius)


def nearest(points: DataFrame, boxes: DataFrame, radius: float) -> DataFrame:
    """pt_id, x, y, n_square, bld_id, d: the nearest box within the radius (the smallest id on a tie), null where there is none.

    Points of one place have one answer, and boxes with the same bounds one distance: places and bounds meet once, whatever number has them.
    A polygon reaches every side of its bounds, so it is no farther than their farthest corner: only polygons whose bounds are nearer than
    the least of these are measured.
    """
    places = points.select(*POINT).distinct()
    bounds_ = boxes.groupBy(*BOX).agg(F.min("bld_id").alias("bld_id"), F.count(F.lit(1)).alias("k"))
    found = within_radius(places, bounds_, radius)
    far = F.expr("sqrt(pow(greatest(abs(x - x0), abs(x - x1)), 2) + pow(greatest(abs(y - y0), abs(y - y1)), 2))")
    best = F.min(F.when(F.col("hit"), F.struct("d", "bld_id"))).alias("best")
    each = found.groupBy(*POINT).agg(F.sum("k").alias("n_square"), *([F.min(far).alias("far")] if "edges" in boxes.columns else [best]))
    if "edges" in boxes.columns:
        each = materialise(points.sparkSession, each, "places")
        near = within_radius(each.select(*POINT, "far"), bounds_, radius).where("hit and d <= far").select(*POINT, *BOX)
        exact = near.join(boxes.select("bld_id", *BOX, "edges"), list(BOX)).select(*POINT, "bld_id", F.expr(point_polygon(*POINT, "edges")).alias("d")).where(F.col("d") <= radius)
        each = each.join(exact.groupBy(*POINT).agg(F.min(F.struct("d", "bld_id")).alias("best")), list(POINT), "left")
    return points.join(each, list(POINT), "left").select("pt_id", "x", "y", F.coalesce("n_square", F.lit(0)).cast("long").alias("n_square"), F.col("best.bld_id").alias("bld_id"), F.col("best.d").alias("d"))


def nearest_by_steps(spark: SparkSession, points: DataFrame, boxes: DataFrame, radius: float, steps: tuple[float, ...] = (1 / 32, 1 / 8, 1.0)) -> DataFrame:
    """As nearest, but each point looks in a small circle first and only those without a hit in the next one; n_square is that of the last circle."""
    left, out = points, None
    for k in steps:
        if out is not None and left.isEmpty():
            break
        found = materialise(spark, nearest(left, boxes, radius * k), "nearest")
        done = found if k == steps[-1] else found.where("bld_id is not null")
        out = done if out is None else out.union(done)
        left = points.join(found.where("bld_id is null").select("pt_id"), "pt_id", "left_semi")
    return out


def _segment_box(pairs: DataFrame, s: tuple[str, ...], b: tuple[str, ...]) -> DataFrame:
    """pairs with d, the distance of a segment and a filled box, and far, the greatest distance of a place of the box; in steps, so that expressions stay small."""
    (x0, y0, x1, y1), (a0, b0, a1, b1) = s, b
    pairs = held(pairs, _dx=F.expr(f"{x1} - {x0}"), _dy=F.expr(f"{y1} - {y0}"))
    pairs = held(pairs, _q=F.expr("_dx * _dx + _dy * _dy"))
    t = {k: F.expr(f"case when _q = 0 then 0e0 else greatest(0e0, least(1e0, (({p} - {x0}) * _dx + ({q} - {y0}) * _dy) / _q)) end") for k, (p, q) in enumerate((p, q) for p in (a0, a1) for q in (b0, b1))}
    pairs = held(pairs, **{f"_t{k}": v for k, v in t.items()})
    ends = [(p, q) for p in (a0, a1) for q in (b0, b1)]
    pairs = held(pairs, **{f"_c{k}": F.expr(f"pow({p} - ({x0} + _t{k} * _dx), 2) + pow({q} - ({y0} + _t{k} * _dy), 2)") for k, (p, q) in enumerate(ends)})
    side = lambda o, d, p, q: (f"case when {d} = 0 then 0e0 else least(({p} - {o}) / {d}, ({q} - {o}) / {d}) end", f"case when {d} = 0 then 1e0 else greatest(({p} - {o}) / {d}, ({q} - {o}) / {d}) end")
    (lx, hx), (ly, hy) = side(x0, "_dx", a0, a1), side(y0, "_dy", b0, b1)
    flat = f"(_dx <> 0 or {x0} between {a0} and {a1}) and (_dy <> 0 or {y0} between {b0} and {b1})"
    pairs = held(pairs, _in=F.expr(f"{flat} and greatest(0e0, {lx}, {ly}) <= least(1e0, {hx}, {hy})"), _e0=F.expr(point_box(x0, y0, *b)), _e1=F.expr(point_box(x1, y1, *b)))
    pairs = pairs.withColumn("d", F.expr("case when _in then 0e0 else least(sqrt(least(_c0, _c1, _c2, _c3)), _e0, _e1) end")).withColumn("far", F.expr("sqrt(greatest(_c0, _c1, _c2, _c3))"))
    return pairs.select(*[c for c in pairs.columns if not c.startswith("_")])


#: A cell of a quarter of the radius lies within the radius of a shape as a whole if its centre is within this share of it (1 less half a diagonal, rounded down).
INNER = 1 - 0.7072 / 4


def _corners(shapes: DataFrame, size: float, *keys: str) -> DataFrame:
    """keys and the cells (ci, cj) that hold a corner of the shape, each once."""
    at = "edges" if "edges" in shapes.columns else "array(struct(x0, y0), struct(x0, y1 as y0), struct(x1 as x0, y0), struct(x1 as x0, y1 as y0))"
    cell = F.expr(f"array_distinct(transform({at}, e -> struct(cast(floor(e.x0 / {size}) as bigint) as ci, cast(floor(e.y0 / {size}) as bigint) as cj)))")
    return shapes.select(*keys, F.explode(cell).alias("c")).select(*keys, "c.ci", "c.cj")


def _spots(runs: DataFrame) -> DataFrame:
    """Runs -> a row per cell."""
    return runs.withColumn("ci", F.explode(F.sequence("a", "b"))).drop("a", "b")


def _worth_cells(segments: DataFrame, boxes: DataFrame, radius: float) -> bool:
    """Whether the grid rows and cells of a quarter of the radius along the segments are fewer than the boxes."""
    if radius <= 0:
        return False
    n = segments.agg(F.sum(F.expr(f"10 + 32 * sqrt((sx1 - sx0) * (sx1 - sx0) + (sy1 - sy0) * (sy1 - sy0)) / {radius}"))).first()[0]
    return n is not None and n <= boxes.count()


def meeting(boxes: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """Boxes within the radius of any of the segments (a corridor); each once.

    A shape with a corner in a cell that lies within the radius of a segment as a whole isn't measured, however many segments are near it.
    A polygon whose bounds lie within the radius of one segment (no place of a box is farther than its corners) isn't measured itself.
    """
    s = segments.select(F.col("x0").alias("sx0"), F.col("y0").alias("sy0"), F.col("x1").alias("sx1"), F.col("y1").alias("sy1")).distinct()
    s = s.select("*", F.least("sx0", "sx1").alias("lx"), F.least("sy0", "sy1").alias("ly"), F.greatest("sx0", "sx1").alias("hx"), F.greatest("sy0", "sy1").alias("hy"))
    own = ("sx0", "sy0", "sx1", "sy1")
    near = lambda b: _segment_box(box_pairs(b.select("bld_id", *BOX), BOX, s, ("lx", "ly", "hx", "hy"), radius), own, BOX)
    by_cell, left = None, boxes
    if _worth_cells(s, boxes, radius):
        band = buffer_segments(s.select(*[F.col(f"s{c}").alias(c) for c in SEGMENT]), radius * INNER, radius / 4)
        by_cell = materialise(boxes.sparkSession, _corners(boxes, radius / 4, "bld_id").join(_spots(band), ["ci", "cj"], "left_semi").select("bld_id").distinct(), "sure")
        left = boxes.join(by_cell, "bld_id", "left_anti")
    found = near(left).groupBy("bld_id").agg(F.min("d").alias("d"), F.min("far").alias("far")).where(F.col("d") <= radius)
    if "edges" not in boxes.columns:
        found = found.select("bld_id")
        return boxes.join(found.union(by_cell) if by_cell else found, "bld_id", "left_semi")
    found = materialise(boxes.sparkSession, found.select("bld_id", (F.col("far") <= radius).alias("sure")), "near")
    open_ = boxes.join(found.where("not sure").select("bld_id"), "bld_id", "left_semi")
    rest = near(open_).where(F.col("d") <= radius).select("bld_id", *own).join(boxes.select("bld_id", "edges"), "bld_id")
    rest = rest.withColumn("held", F.expr(inside("sx0", "sy0", "edges"))).withColumn("e", F.explode("edges")).where(F.expr(f"held or {segment_segment(own, _EDGE)} <= {radius}"))
    found = found.where("sure").select("bld_id").union(rest.select("bld_id"))
    return boxes.join((found.union(by_cell) if by_cell else found).distinct(), "bld_id", "left_semi")


def seeds(points: DataFrame, boxes: DataFrame, corridor: DataFrame, radius: float) -> DataFrame:
    """pt_id, bld_id, d, reason: the nearest box of each point if it lies in the corridor (boxes by bld_id), else why not."""
    best = nearest_by_steps(points.sparkSession, points, boxes, radius).join(corridor.select("bld_id", F.lit(True).alias("inside")), "bld_id", "left")
    away = F.concat(F.lit("nearest_not_in_corridor (d="), F.format_string("%.1f", F.col("d")), F.lit("m)"))
    reason = F.when(F.col("n_square") == 0, "no_hits_in_bbox").when(F.col("bld_id").isNull(), "no_building_within_max_seed_dist").when(F.col("inside").isNull(), away)
    return best.select("pt_id", "bld_id", "d", reason.alias("reason"))


def close_keys(candidates: DataFrame, seed_boxes: DataFrame, radius: float, *keys: str) -> DataFrame:
    """bld_id, keys: each candidate within the radius of a seed box, with the distinct keys (an array of structs) of the seed boxes that near.

    A candidate with a corner in a cell that lies within the radius of a seed as a whole isn't measured for the seed's key. The others meet first the
    bounds of all seeds of a key near one place, then those of the keys whose bounds are near.
    Polygons of which two corners are within the radius aren't measured any more, nor is a candidate again for a key that it has.
    """
    spark, box, sbox = candidates.sparkSession, BOX, ("sx0", "sy0", "sx1", "sy1")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("any"))
    s = seed_boxes.select(*keys, *[F.col(c).alias(f"s{c}") for c in _shape(seed_boxes)])
    s = s.dropDuplicates([*keys, *[f"s{c}" for c in BOX]]) if "edges" not in seed_boxes.columns else s
    near, sure = candidates, None
    if radius > 0:
        if "edges" in seed_boxes.columns:
            inner = buffer_rings(seed_boxes.select(*keys, "bld_id", F.explode("edges").alias("e")).select(*keys, "bld_id", *_EDGE), radius * INNER, radius / 4, *keys)
        else:
            inner = buffer_boxes(seed_boxes, radius * INNER, radius / 4, *keys)
        spots = _spots(inner).groupBy("ci", "cj").agg(F.collect_set(key).alias("ks"))
        sure = _corners(candidates, radius / 4, "bld_id").join(spots, ["ci", "cj"]).groupBy("bld_id").agg(F.array_distinct(F.flatten(F.collect_set("ks"))).alias("had"))
        sure = materialise(spark, sure, "sure")
        size = radius * 2.8
        together = s.groupBy(*keys, F.expr(f"cast(floor(sx0 / {size}) as bigint)").alias("gi"), F.expr(f"cast(floor(sy0 / {size}) as bigint)").alias("gj"))
        together = together.agg(F.min("sx0").alias("sx0"), F.min("sy0").alias("sy0"), F.max("sx1").alias("sx1"), F.max("sy1").alias("sy1")).drop("gi", "gj")
        left = candidates.join(sure, "bld_id", "left").select("bld_id", *BOX, "had") if keys else candidates.join(sure, "bld_id", "left_anti").select("bld_id", *BOX)
        near = box_pairs(left, BOX, together, sbox, radius)
        near = (near.where(F.col("had").isNull() | ~F.array_contains("had", key)) if keys else near).select(*keys, "bld_id").distinct()
        near = materialise(spark, near.join(candidates.select("bld_id", *_shape(candidates)), "bld_id"), "open")
    on = keys if radius > 0 else ()
    pairs = box_pairs(near.select(*on, "bld_id", *_shape(candidates)), box, s, sbox, radius, *on)
    pairs = pairs.where(F.expr(f"{box_box(sbox, BOX)} <= {radius}"))
    found = pairs.select(*keys, "bld_id")
    if "edges" in candidates.columns:
        corner = f"exists(edges, e -> exists(sedges, f -> (e.x0 - f.x0) * (e.x0 - f.x0) + (e.y0 - f.y0) * (e.y0 - f.y0) <= {radius * radius}))"
        pairs = materialise(spark, pairs.select(*keys, "bld_id", F.expr(corner).alias("sure"), F.when(~F.expr(corner), F.struct("edges", "sedges")).alias("p")), "near")
        by_corner = pairs.where("sure").select(*keys, "bld_id").distinct()
        rest = pairs.where("not sure").join(by_corner, [*keys, "bld_id"], "left_anti").select(*keys, "bld_id", "p.*")
        held = f"{inside('edges[0].x0', 'edges[0].y0', 'sedges')} or {inside('sedges[0].x0', 'sedges[0].y0', 'edges')}"
        rest = rest.withColumn("held", F.expr(held)).withColumn("e", F.explode("edges")).withColumn("f", F.explode("sedges"))
        rest = rest.where(F.expr(f"held or {segment_segment(('f.x0', 'f.y0', 'f.x1', 'f.y1'), _EDGE)} <= {radius}"))
        found = by_corner.union(rest.select(*keys, "bld_id"))
    found = found.groupBy("bld_id").agg(F.collect_set(key).alias("had"))
    if sure is not None:
        found = found.union(sure).groupBy("bld_id").agg(F.flatten(F.collect_list("had")).alias("had"))
    return found.withColumnRenamed("had", "keys")


def close_pairs(candidates: DataFrame, seed_boxes: DataFrame, radius: float, *keys: str) -> DataFrame:
    """Candidates with the distinct keys of the seed boxes within the radius of them (see close_keys)."""
    found = close_keys(candidates, seed_boxes, radius, *keys)
    if not keys:
        return candidates.join(found, "bld_id", "left_semi")
    return candidates.join(found.select("bld_id", F.explode("keys").alias("k")).select("bld_id", "k.*"), "bld_id")


def grown(candidates: DataFrame, seed_boxes: DataFrame, radius: float) -> DataFrame:
    """Candidates within the radius of any seed box; each once."""
    return close_pairs(candidates, seed_boxes, radius)


def _bounded(segments: DataFrame) -> DataFrame:
    low, high = (lambda c: F.least(f"{c}0", f"{c}1")), (lambda c: F.greatest(f"{c}0", f"{c}1"))
    return segments.select("*", low("x").alias("lx"), low("y").alias("ly"), high("x").alias("hx"), high("y").alias("hy"))


def _beside(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """Each segment with the points of its line that lie within the radius of its bounds."""
    p = points.select("line_id", "x", "y", F.col("x").alias("x_"), F.col("y").alias("y_")).distinct()
    return box_pairs(_bounded(segments), ("lx", "ly", "hx", "hy"), p, ("x", "y", "x_", "y_"), radius, "line_id").drop("lx", "ly", "hx", "hy", "x_", "y_")


def close_segments(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """The segments within the radius of any point of their line."""
    close = _beside(points, segments, radius).where(F.expr(f"{point_segment(*POINT, *SEGMENT)} <= {radius}"))
    return segments.join(close.select("line_id", "seg_no").distinct(), ["line_id", "seg_no"], "left_semi")


def near_points(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """points(line_id, x, y) -> parts (line_id, a, b): the stretches of each line, from measure a to b, within the radius of any of its points."""
    dx, dy, ex, ey = "(x1 - x0)", "(y1 - y0)", "(x0 - x)", "(y0 - y)"
    pairs = _beside(points, segments, radius)
    pairs = pairs.selectExpr("line_id", "m0", f"{dx} * {dx} + {dy} * {dy} as q", f"{dx} * {ex} + {dy} * {ey} as p", f"{ex} * {ex} + {ey} * {ey} - {radius * radius} as r").where("q > 0 and p * p >= q * r")
    ends = F.expr("struct(sqrt(q) as len, (-p - sqrt(p * p - q * r)) / q as s, (-p + sqrt(p * p - q * r)) / q as t)")
    cut = pairs.select("line_id", "m0", F.explode(F.array(ends)).alias("e")).select("line_id", "m0", "e.*").where("s <= 1 and t >= 0")  # a generator, so that they are computed once
    cut = cut.selectExpr("line_id", "m0 + len * greatest(0e0, s) as a", "m0 + len * least(1e0, t) as b").distinct()
    before = Window.partitionBy("line_id").orderBy("a", "b")
    cut = cut.withColumn("far", F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1))).withColumn("part", F.sum(F.expr("case when far is null or a > far + 1e-9 then 1 else 0 end")).over(before))
    return cut.groupBy("line_id", "part").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("part")


def cut(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """segments between the measures a and b of their line's part; m0 stays that of the whole line."""
    length = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
    s = segments.withColumn("len", F.expr(length)).join(parts, "line_id").where("m0 < b and m0 + len > a")
    at = lambda c, m: f"case when {m} <= m0 then {c}0 when {m} >= m0 + len then {c}1 else {c}0 + ({c}1 - {c}0) * ({m} - m0) / len end"
    return s.selectExpr("line_id", "seg_no", f"{at('x', 'a')} as x0", f"{at('y', 'a')} as y0", f"{at('x', 'b')} as x1", f"{at('y', 'b')} as y1", "greatest(m0, a) as m0")


def measures(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points with line_id -> pt_id, line_id, d, m: distance from the line, and where along it the nearest place is (the first segment on a tie).

    Of a line of n segments the start of about each square root of n-th bounds the distance; only segments whose bounds are as near are measured, so
    a point never meets all of a long line.
    """
    step = segments.groupBy("line_id").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("step"))
    marks = segments.join(step, "line_id").where("seg_no % step = 0").select("line_id", F.col("x0").alias("mx"), F.col("y0").alias("my"))
    places = points.select("line_id", "x", "y").distinct()
    far = places.join(marks, "line_id").groupBy("line_id", "x", "y").agg(F.min(F.expr("(x - mx) * (x - mx) + (y - my) * (y - my)")).alias("q"))
    far = far.select("line_id", "x", "y", F.expr("sqrt(q) * (1 + 1e-9) + 1e-9").alias("r")).selectExpr("line_id", "x", "y", "x - r as px0", "y - r as py0", "x + r as px1", "y + r as py1")
    near = box_pairs(_bounded(segments), ("lx", "ly", "hx", "hy"), far, ("px0", "py0", "px1", "py1"), 0.0, "line_id")
    t = param(*POINT, *SEGMENT)
    found = near.select("line_id", "x", "y", "seg_no", F.expr(point_segment(*POINT, *SEGMENT)).alias("d"), F.expr(f"m0 + {t} * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))").alias("m"))
    best = found.groupBy("line_id", "x", "y").agg(F.min(F.struct("d", "seg_no", "m")).alias("r"))
    return points.join(best, ["line_id", "x", "y"]).select("pt_id", "line_id", "r.d", "r.m")


def samples(measured: DataFrame, segments: DataFrame, n: int = 300, pad: float = 10.0) -> DataFrame:
    """line_id, i, m, x, y: n equally spaced places on each line from the least measure less pad to the greatest plus pad, within the line."""
    length = segments.groupBy("line_id").agg(F.max(F.expr("m0 + sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))")).alias("len"), F.max("seg_no").alias("last"))
    ends = measured.groupBy("line_id").agg(F.min("m").alias("a"), F.max("m").alias("b")).join(length, "line_id")
    ends = ends.select("line_id", "last", F.expr(f"greatest(0e0, a - {pad})").alias("a"), F.expr(f"least(len, b + {pad})").alias("b"))
    at = ends.select("line_id", "last", F.explode(F.expr(f"sequence(0, {n - 1})")).alias("i"), "a", "b").withColumn("m", F.expr(f"a + (b - a) * i / {n - 1}"))
    s = segments.withColumn("m1", F.expr("m0 + sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"))
    on = at.join(s, "line_id").where("m >= m0 AND (m < m1 OR seg_no = last)")
    t = "(CASE WHEN m1 = m0 THEN 0e0 ELSE least(1e0, (m - m0) / (m1 - m0)) END)"
    return on.select("line_id", "i", "m", F.expr(f"x0 + {t} * (x1 - x0)").alias("x"), F.expr(f"y0 + {t} * (y1 - y0)").alias("y"))


def points_in_polygons(points: DataFrame, edges: DataFrame, size: float = 100.0) -> DataFrame:
    """edges(poly_id, x0, y0, x1, y1) of rings -> poly_id, pt_id of points inside, by ray casting.

    Each place meets, once, the polygons whose bounds hold it, and of these the edges in the grid rows of its y.
    """
    places = points.select("x", "y", F.col("x").alias("x_"), F.col("y").alias("y_")).distinct()
    boxes = _bounded(edges).groupBy("poly_id").agg(F.min("lx").alias("lx"), F.min("ly").alias("ly"), F.max("hx").alias("hx"), F.max("hy").alias("hy"))
    at = box_pairs(boxes, ("lx", "ly", "hx", "hy"), places, ("x", "y", "x_", "y_"), 0.0).select("poly_id", "x", "y", F.expr(f"cast(floor(y / {size}) as bigint)").alias("cj"))
    rows = edges.withColumn("cj", F.explode(F.expr(f"sequence(cast(floor(least(y0, y1) / {size}) as bigint), cast(floor(greatest(y0, y1) / {size}) as bigint))")))
    inner = at.join(rows, ["poly_id", "cj"]).where(F.expr(crosses_ray(*POINT, *SEGMENT))).groupBy("poly_id", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return points.join(inner, ["x", "y"]).select("poly_id", "pt_id")


def meeting_polygons(shapes: DataFrame, edges: DataFrame, size: float = 100.0) -> DataFrame:
    """shapes(id, area, x0, y0, x1, y1), the edges of lines, points (both ends the same) and, where `area`, rings; edges(poly_id, x0, y0, x1, y1) ->
    the distinct poly_id, id of shapes and polygons that have a place in common: an edge crosses or touches one of the polygon's, or an end lies inside, or the polygon lies in the shape."""
    s = _bounded(shapes.select(F.col("id"), *[F.col(c).alias(f"s{c}") for c in SEGMENT]).select("*", *[F.col(f"s{c}").alias(c) for c in SEGMENT])).drop(*SEGMENT)
    e = _bounded(edges).withColumnsRenamed({"lx": "qx0", "ly": "qy0", "hx": "qx1", "hy": "qy1"})
    crossed = box_pairs(s, ("lx", "ly", "hx", "hy"), e, ("qx0", "qy0", "qx1", "qy1"), 0.0).where(F.expr(f"{segment_segment(('sx0', 'sy0', 'sx1', 'sy1'), SEGMENT)} = 0"))
    first = shapes.groupBy("id").agg(F.min(F.struct("x0", "y0")).alias("p")).select(F.col("id").alias("pt_id"), F.col("p.x0").alias("x"), F.col("p.y0").alias("y"))
    within = points_in_polygons(first, edges, size).select("poly_id", F.col("pt_id").alias("id"))
    corner = edges.groupBy("poly_id").agg(F.min(F.struct("x0", "y0")).alias("p")).select(F.col("poly_id").alias("pt_id"), F.col("p.x0").alias("x"), F.col("p.y0").alias("y"))
    around = points_in_polygons(corner, shapes.where("area").select(F.col("id").alias("poly_id"), *SEGMENT), size).select(F.col("pt_id").alias("poly_id"), F.col("poly_id").alias("id"))
    return crossed.select("poly_id", "id").union(within).union(around).distinct()


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def ring_measures(edges: DataFrame) -> DataFrame:
    """poly_id, area, cx, cy: shoelace area and centroid of rings."""
    k = "(x0 * y1 - x1 * y0)"
    s = edges.groupBy("poly_id").agg(F.sum(F.expr(f"{k} / 2")).alias("a"), F.sum(F.expr(f"(x0 + x1) * {k}")).alias("sx"), F.sum(F.expr(f"(y0 + y1) * {k}")).alias("sy"))
    return s.select("poly_id", F.abs("a").alias("area"), F.expr("sx / (6 * a)").alias("cx"), F.expr("sy / (6 * a)").alias("cy"))


def longest_part(parts: DataFrame) -> DataFrame:
    """parts(line_id, part_no, len) -> the longest part of each line, the first on a tie."""
    return parts.groupBy("line_id").agg(F.max_by(F.struct("part_no", "len"), F.struct("len", (-F.col("part_no")))).alias("p")).select("line_id", "p.*")
