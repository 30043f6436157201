"""Polygons from edges: dissolve, repair and outlines, as joins over edges, rings and their ends; no shape passes through one task.

Tables: edges(key, ring, x0, y0, x1, y1, w). A key's shape is where the sum of its rings' winding numbers times w is above 0, so with w of 1
for shells and -1 for holes, turned by `oriented`, several polygons of a key are dissolved and crossing rings are repaired. Edges are split
where they meet, on a grid of `snap`; what has the shape on one side only is its outline, which is traced to rings with the shape at the left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardcraft.operators.spatial import _levels, _upwards, box_pairs, level
from wardcraft.plans.lists import traced
from wardcraft.plans.shared import materialise
from wardcraft.sources import wkb

ENDS = ("x0", "y0", "x1", "y1")
_BOX = ("lx", "ly", "hx", "hy")


def _rows(names: str, *rows: str) -> Column:
    """One row for each of the texts of values, by these names."""
    named = [", ".join(f"{v.strip()} as {n}" for n, v in zip(names.split(), r.split(","), strict=True)) for r in rows]
    return F.explode(F.expr("array(" + ", ".join(f"struct({x})" for x in named) + ")"))


def _bounded(edges: DataFrame) -> DataFrame:
    low, high = (lambda c: F.least(f"{c}0", f"{c}1")), (lambda c: F.greatest(f"{c}0", f"{c}1"))
    return edges.select("*", low("x").alias("lx"), low("y").alias("ly"), high("x").alias("hx"), high("y").alias("hy"))


def oriented(edges: DataFrame, hole: Column | None = None) -> DataFrame:
    """edges(key, ring, x0, y0, x1, y1) of closed rings, walked either way -> with w: 1, or -1 for a hole, for rings that turn left at their highest place, else the opposite."""
    top, low = (lambda p: F.struct(f"y{p}", f"x{p}")), (lambda p, q: F.struct(F.col(f"x{p}").alias("x"), F.col(f"y{p}").alias("y")))
    real = edges.where("x0 <> x1 or y0 <> y1").repartition("key", "ring")  # once, for the tips and for the join
    tip = real.groupBy("key", "ring").agg(F.max(top(1)).alias("t"), F.max_by(low(0, 1), top(1)).alias("p"), F.max_by(low(1, 0), top(0)).alias("n"), F.sum(F.expr("x0 * y1 - x1 * y0")).alias("a"))
    turn = F.expr("(t.x1 - p.x) * (n.y - t.y1) - (t.y1 - p.y) * (n.x - t.x1)")
    tip = tip.select("key", "ring", F.when(F.when(turn == 0, F.col("a")).otherwise(turn) < 0, -1).otherwise(1).alias("w"))
    out = real.join(tip.hint("merge"), ["key", "ring"])
    return out if hole is None else out.withColumn("w", F.when(hole, -F.col("w")).otherwise(F.col("w")))


#: Keys of up to so many edges are met whole; the edges of others meet in cells.
FEW = 24
_LINE = ("ax", "ay", "bx", "by")


def _up(*columns: str) -> list[Column]:
    """Ends p and q and a number n -> ax, ay, bx, by, n of the line from its lower end to its upper one (the left one to the right one)."""
    up = F.expr("qy > py or (qy = py and qx > px)")
    ends = [F.when(up, F.col(f"{p}{c}")).otherwise(F.col(f"{q}{c}")).alias(f"{name}{c}") for name, p, q in (("a", "p", "q"), ("b", "q", "p")) for c in "xy"]
    return [*[F.col(c) for c in columns], *ends, F.when(up, F.col("n")).otherwise(-F.col("n")).alias("n")]


def _summed(lines: DataFrame) -> DataFrame:
    """lines(key, ax, ay, bx, by, n) -> the same, with those along an axis summed up over every stretch, and other equal ones; what adds to 0 goes.

    A key's lines along an axis then are disjoint, however many shapes lie on each other.
    """
    straight = lines.where("ax = bx or ay = by").select("key", F.expr("ay = by").alias("flat"), F.expr("case when ay = by then ay else ax end").alias("c"), "n", F.expr("case when ay = by then ax else ay end").alias("u"), F.expr("case when ay = by then bx else by end").alias("v"))
    ends = straight.groupBy("key", "flat", "c", "u", "v").agg(F.sum("n").alias("n")).where("n <> 0")
    ends = ends.select("key", "flat", "c", _rows("at n", "u, n", "v, -n").alias("e")).select("key", "flat", "c", "e.*").groupBy("key", "flat", "c", "at").agg(F.sum("n").alias("n")).where("n <> 0")
    of = Window.partitionBy("key", "flat", "c").orderBy("at")  # the places on one line along an axis
    runs = ends.select("key", "flat", "c", "at", F.lead("at").over(of).alias("to"), F.sum("n").over(of).alias("n")).where("n <> 0")
    runs = runs.select("key", *[F.expr(f"case when flat then {p} else {q} end").alias(c) for c, p, q in (("ax", "at", "c"), ("ay", "c", "at"), ("bx", "to", "c"), ("by", "c", "to"))], "n")
    rest = lines.where("ax <> bx and ay <> by").groupBy("key", *_LINE).agg(F.sum("n").alias("n")).where("n <> 0")
    return runs.select("key", *_LINE, "n").unionByName(rest.select("key", *_LINE, "n"))


def _pairs(lines: DataFrame, few: bool, first: bool) -> DataFrame:
    """lines(eid, key, ax, ..., moved) -> pairs, columns of the second with _, of lines of a key whose boxes meet, one of which has moved; each pair once. few: a key's lines meet whole."""
    named = lambda df: df.select("key", *[F.col(c).alias(f"{c}_") for c in ("eid", *_LINE, "n", "moved")])
    boxed = "least(ax, bx) <= greatest(ax_, bx_) and least(ax_, bx_) <= greatest(ax, bx) and ay <= by_ and ay_ <= by"
    once = "eid <> eid_ and (moved or moved_) and (eid < eid_ or not moved_)" if not first else "eid < eid_"
    if few:
        return lines.join(named(lines).hint("merge"), "key").where(f"eid = eid_ or (eid < eid_ and (moved or moved_) and {boxed})")
    low, high = (("least(ax, bx)", "greatest(ax, bx)"), ("ay", "by"))
    placed = lines.withColumn("own", F.expr(level("greatest(abs(bx - ax), by - ay)")))
    span = lambda c: f"sequence(cast(floor({c[0]} / pow(2e0, lv)) as bigint), cast(floor({c[1]} / pow(2e0, lv)) as bigint))"
    at = _upwards(placed, _levels(placed)).withColumn("ci", F.explode(F.expr(span(low)))).withColumn("cj", F.explode(F.expr(span(high))))
    cell = ["key", "lv", "ci", "cj"]
    left = at if first else at.where("moved")
    right = at.select(*cell, *[F.col(c).alias(f"{c}_") for c in ("eid", *_LINE, "n", "moved", "own")])
    corner = "ci = floor(greatest(least(ax, bx), least(ax_, bx_)) / pow(2e0, lv)) and cj = floor(greatest(ay, ay_) / pow(2e0, lv))"
    return left.join(right.hint("merge"), cell).where(f"{once} and lv = greatest(own, own_) and {corner} and {boxed}").drop("lv", "ci", "cj", "own", "own_")


def _split(lines: DataFrame, few: bool, first: bool) -> DataFrame:
    """lines(eid, key, ax, ay, bx, by, n, moved) -> their parts between the places where others of the key cross or touch them; moved: an end was moved to the grid, off its line."""
    rx, ry, sx, sy, qx, qy = "(bx - ax)", "(by - ay)", "(bx_ - ax_)", "(by_ - ay_)", "(ax_ - ax)", "(ay_ - ay)"
    d = f"({rx} * {sy} - {ry} * {sx})"
    on = f"struct(case when {d} = 0 then null else ({qx} * {sy} - {qy} * {sx}) / {d} end as t, case when {d} = 0 then null else ({qx} * {ry} - {qy} * {rx}) / {d} end as u, {qx} * {ry} - {qy} * {rx} as off)"
    pairs = _pairs(lines, few, first)
    pairs = pairs.select("*", F.explode(F.array(F.expr(on))).alias("m")).select("*", "m.*").drop("m")
    pairs = pairs.where(("eid = eid_ or " if few else "") + "(t between 0 and 1 and u between 0 and 1) or (t is null and off = 0)")
    pairs = pairs.select("*", F.explode(F.array(F.expr(f"struct(rint(ax + t * {rx}) as x, rint(ay + t * {ry}) as y)"))).alias("p"))
    one, other = (f"eid{k} as eid, " + ", ".join(f"{c}{k} as {c}" for c in _LINE) + f", n{k} as n" for k in ("", "_"))
    item = lambda e, x, y: f"struct({e}, {x} as x, {y} as y)"
    none = item(one, "cast(null as double)", "cast(null as double)")
    found = f"case when eid = eid_ then array({none}) when t is null then array({item(one, 'ax_', 'ay_')}, {item(one, 'bx_', 'by_')}, {item(other, 'ax', 'ay')}, {item(other, 'bx', 'by')}) else array({item(one, 'p.x', 'p.y')}, {item(other, 'p.x', 'p.y')}) end"
    places = pairs.select("key", F.explode(F.expr(found)).alias("e")).select("key", "e.*")
    places = places.where("x is null or ((x <> ax or y <> ay) and (x <> bx or y <> by) and x between least(ax, bx) and greatest(ax, bx) and y between ay and by)")
    if not few:
        places = places.unionByName(lines.select("key", "eid", *_LINE, "n", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")))
    place = F.struct(F.expr("abs(x - ax) + abs(y - ay)").alias("t"), "x", "y")
    cut = places.groupBy("key", "eid", *_LINE, "n").agg(F.array_sort(F.collect_set(F.when(F.col("x").isNotNull(), place))).alias("at"))
    ends = F.expr("concat(array(struct(0e0 as t, ax as x, ay as y)), at, array(struct(0e0 as t, bx as x, by as y)))")
    parts = cut.withColumn("at", F.explode(F.array(ends))).select("*", F.explode(F.expr("transform(sequence(1, size(at) - 1), k -> struct(at[k - 1] as p, at[k] as q))")).alias("s"))
    off = lambda p: f"({rx} * (s.{p}.y - ay) - {ry} * (s.{p}.x - ax) <> 0)"
    parts = parts.select("key", "n", F.expr(f"{off('p')} or {off('q')}").alias("moved"), *[F.col(f"s.{p}.{c}").alias(f"{p}{c}") for p in "pq" for c in "xy"])
    return parts.select(*_up("key", "moved"))


def noded(spark: SparkSession, lines: DataFrame, few: bool = False) -> DataFrame:
    """lines(key, ax, ay, bx, by, n) with whole coordinates -> parts of them that meet at ends only.

    Where a part was moved to the grid it may cross another one, so this goes on until none is moved. few: no key has many lines.
    """
    now, first = lines.withColumn("moved", F.lit(True)), True
    while True:
        now = materialise(spark, now.select(F.monotonically_increasing_id().alias("eid"), "key", *_LINE, "n", "moved"), "lines")
        if not first and now.where("moved").isEmpty():
            return now.drop("eid", "moved")
        now, first = _split(now, few, first), False


def _right(lines: DataFrame) -> DataFrame:
    """noded lines(key, ax, ay, bx, by, n), each once, of keys with few -> with d, the winding number at the right of each: rays to the east, or to the south from flat ones."""
    other = lines.select("key", *[F.col(c).alias(f"{c}_") for c in (*_LINE, "n")])
    east = "ay <> by and (ay_ <= (ay + by) / 2) <> (by_ <= (ay + by) / 2) and (ax + bx) / 2 < ax_ + ((ay + by) / 2 - ay_) * (bx_ - ax_) / (by_ - ay_)"
    south = "ay = by and (ax_ <= (ax + bx) / 2) <> (bx_ <= (ax + bx) / 2) and ay > ay_ + ((ax + bx) / 2 - ax_) * (by_ - ay_) / (bx_ - ax_)"
    own = "(ax = ax_ and ay = ay_ and bx = bx_ and by = by_)"
    way = f"case when {own} then 0 when {east} then n_ when {south} then case when bx_ > ax_ then n_ else -n_ end else 0 end"
    return lines.join(other.hint("merge"), "key").groupBy("key", *_LINE, "n").agg(F.sum(F.expr(way)).alias("d"))


#: Where tiles begin: no end or middle of a line on the grid lies on a tile's side, and no line goes through a corner.
_AT = (0.3183098861837907, 0.2718281828459045)


def _right_by_tiles(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """As _right, for keys of any number of lines.

    The winding number at a tile's lower left corner is a running sum over the tiles to the west of what crosses their lower sides; from
    there a path goes up the tile's side and then to the east, and meets lines of this tile only.
    """
    size = lines.agg(F.expr("sqrt(avg(pow(greatest(abs(bx - ax), by - ay), 2)))").alias("q"), F.expr("max(greatest(abs(bx - ax), by - ay))").alias("m")).first()
    if size.m is None:
        return lines.withColumn("d", F.lit(0).cast("long"))
    t, (ox, oy) = float(max(1, round(2 * size.q), round(size.m / 64))), _AT
    tile = lambda c, o: f"cast(floor(({c} - {o}) / {t}) as bigint)"
    spanned = lambda p, q, o: F.explode(F.expr(f"sequence({tile(p, o)}, {tile(q, o)})"))
    rows = lines.withColumn("ti", spanned("least(ax, bx)", "greatest(ax, bx)", ox)).withColumn("tj", spanned("ay", "by", oy))
    left = lambda x, y, k="": f"(bx{k} - ax{k}) * ({y} - ay{k}) - (by{k} - ay{k}) * ({x} - ax{k})"
    x, x1, y = f"(ti * {t} + {ox})", f"((ti + 1) * {t} + {ox})", f"(tj * {t} + {oy})"
    low = f"case when ay < {y} and {y} < by and {left(x, y)} > 0 and {left(x1, y)} <= 0 then n else 0 end"
    corners = rows.groupBy("key", "ti", "tj").agg(F.sum(F.expr(low)).alias("low"))
    west = Window.partitionBy("key", "tj").orderBy("ti").rowsBetween(Window.unboundedPreceding, -1)  # the tiles of one row
    corners = corners.select("key", "ti", "tj", (-F.coalesce(F.sum("low").over(west), F.lit(0))).alias("at"))
    middle = lines.withColumn("ti", F.expr(tile("(ax + bx) / 2", ox))).withColumn("tj", F.expr(tile("(ay + by) / 2", oy)))
    other = rows.select("key", "ti", "tj", *[F.col(c).alias(f"{c}_") for c in (*_LINE, "n")])
    px, py = "((ax + bx) / 2)", "((ay + by) / 2)"
    o, turn = left(x, y, "_"), left(x, py, "_")
    # up the side: lines over its corner and under the turn, where a flat one at the turn's height lies under the path, but not under one that runs beneath a flat line
    up = f"case when least(ax_, bx_) < {x} and {x} < greatest(ax_, bx_) and (bx_ > ax_ and {o} <= 0 and ({turn} > 0 or ({turn} = 0 and ay <> by))) then n_ when least(ax_, bx_) < {x} and {x} < greatest(ax_, bx_) and bx_ < ax_ and {o} > 0 and {turn} < 0 then -n_ else 0 end"
    crossed = f"case when ay = by then (ay_ < {py}) <> (by_ < {py}) else (ay_ <= {py}) <> (by_ <= {py}) end"
    own = "(ax = ax_ and ay = ay_ and bx = bx_ and by = by_)"
    east = f"case when {own} and ay <> by then n_ when {crossed} and {turn} > 0 and ax_ + ({py} - ay_) * (bx_ - ax_) / (by_ - ay_) < {px} then n_ else 0 end"
    met = middle.join(other.hint("merge"), ["key", "ti", "tj"]).groupBy("key", "ti", "tj", *_LINE, "n").agg(F.sum(F.expr(f"{up} - {east}")).alias("way"))
    return met.join(corners.hint("merge"), ["key", "ti", "tj"]).select("key", *_LINE, "n", F.expr("at + way").alias("d"))


def _turned(edges: DataFrame) -> DataFrame:
    """Edges turned so that rays go along v: mode 0 to the east (u is y), mode 1 to the south (u is x)."""
    return edges.withColumn("_m", _rows("mode u0 v0 u1 v1", "0, y0, x0, y1, x1", "1, x0, -y0, x1, -y1")).select("*", "_m.*").drop("_m")


def windings(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points(q, key, mode, x, y, [ax, ay, bx, by]) and edges(key, ring, x0, y0, x1, y1, w) that don't cross -> q, ring, n: winding numbers times w of
    the rings whose bounds hold the point; an edge with the ends a and b, on which the point lies, doesn't count.

    A ray meets only the edges in its row of the ring; a ring has as many rows as edges.
    """
    own = "ax" in points.columns
    boxes = _bounded(edges).groupBy("key", "ring").agg(F.min("lx").alias("lx"), F.min("ly").alias("ly"), F.max("hx").alias("hx"), F.max("hy").alias("hy"), F.count(F.lit(1)).alias("m"))
    at = box_pairs(boxes, _BOX, points.select("*", F.col("x").alias("x_"), F.col("y").alias("y_")), ("x", "y", "x_", "y_"), 0.0, "key")
    row = "cast(floor(({} - case when mode = 0 then ly else lx end) * m / greatest(case when mode = 0 then hy - ly else hx - lx end, 1e0)) as bigint)"
    at = at.select("*", F.expr("case when mode = 0 then y else x end").alias("u"), F.expr("case when mode = 0 then x else -y end").alias("v")).withColumn("row", F.expr(row.format("u"))).select("q", "key", "ring", "mode", "u", "v", "row", *(["ax", "ay", "bx", "by"] if own else []))
    rows = _turned(edges.join(boxes.hint("merge"), ["key", "ring"])).where("u0 <> u1")
    rows = rows.withColumn("row", F.explode(F.expr(f"sequence({row.format('least(u0, u1)')}, {row.format('greatest(u0, u1)')})")))
    met = at.hint("merge").join(rows.select("key", "ring", "mode", "row", "w", *ENDS, "u0", "v0", "u1", "v1"), ["key", "ring", "mode", "row"])
    met = met.where("(u0 <= u) <> (u1 <= u) and v < v0 + (u - u0) * (v1 - v0) / (u1 - u0)")
    if own:
        met = met.where("not (x0 = ax and y0 = ay and x1 = bx and y1 = by) and not (x1 = ax and y1 = ay and x0 = bx and y0 = by)")
    return met.groupBy("q", "ring").agg(F.sum(F.expr("case when u1 > u0 then w else -w end")).alias("n"))


def boundary(spark: SparkSession, edges: DataFrame, snap: float = 1e-6) -> DataFrame:
    """edges(key, ring, x0, y0, x1, y1, w) -> key, x0, y0, x1, y1: the outlines of the keys' shapes, the shape at the left; whole grid coordinates."""
    on_grid = edges.select("key", *[F.rint(F.col(c) / snap).alias(p) for c, p in zip(ENDS, ("px", "py", "qx", "qy"), strict=True)], F.col("w").cast("long").alias("n")).where("px <> qx or py <> qy")
    lines = materialise(spark, on_grid.select(*_up("key")), "edges")
    many = lines.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    many = materialise(spark, many.select("key", (F.col("k") > FEW).alias("many")), "keys")
    kinds = {r.many for r in many.groupBy("many").count().collect()}  # two rows
    of = lambda kind: lines if len(kinds) == 1 else lines.join(many.where(F.col("many") == kind), "key", "left_semi")
    summed = lambda df: df.groupBy("key", *_LINE).agg(F.sum("n").alias("n")).where("n <> 0")
    sides = []
    if False in kinds or not kinds:
        sides.append(_right(summed(noded(spark, of(False), True).repartition("key"))))
    if True in kinds:
        sides.append(_right_by_tiles(spark, materialise(spark, summed(noded(spark, _summed(of(True)))), "lines")))
    kept = reduce(DataFrame.unionByName, sides).where("(d > 0) <> (d + n > 0)")
    turned = lambda p, q: F.expr(f"case when d + n > 0 then {p} else {q} end")
    return kept.select("key", turned("ax", "bx").alias("x0"), turned("ay", "by").alias("y0"), turned("bx", "ax").alias("x1"), turned("by", "ay").alias("y1"))


def _followers(edges: DataFrame, first: bool, *on: str) -> DataFrame:
    """edges(id, key, x0, ..., on) -> id, next, turns: of the edges that start where one ends, the first one clockwise from the way back, or the last; turns: it isn't straight on."""
    after = edges.select("key", *on, F.col("id").alias("next"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.expr("x1 - x0").alias("fx"), F.expr("y1 - y0").alias("fy"))
    pairs = edges.select("id", "key", *on, "x1", "y1", F.expr("x0 - x1").alias("bx"), F.expr("y0 - y1").alias("by")).join(after.hint("merge"), ["key", *on, "x1", "y1"])
    cross, dot = "(bx * fy - by * fx)", "(bx * fx + by * fy)"
    clockwise = F.expr(f"case when {cross} < 0 then -atan2({cross}, {dot}) when {cross} > 0 then 2 * pi() - atan2({cross}, {dot}) when {dot} < 0 then pi() else 2 * pi() end")
    pick = F.min_by if first else F.max_by
    return pairs.groupBy("id").agg(pick(F.struct("next", F.expr(f"{cross} <> 0 or {dot} > 0").alias("turns")), F.struct(clockwise, "next")).alias("f")).select("id", "f.next", "f.turns")


def rings(spark: SparkSession, outline: DataFrame, snap: float = 1.0) -> DataFrame:
    """Directed edges(key, x0, y0, x1, y1) of outlines, the shape at the left -> key, ring, seq, x, y, turns, area2: the edges' starts in order.

    Rings are simple. Where shapes touch at a corner they get rings of their own; a ring that would pass a place twice is a shape that closes
    round a hole there, and is cut in two. area2 is twice the ring's area, below 0 for holes; `turns` is false where the outline goes straight on.
    """
    edges = outline.repartitionByRange("key", "y0", "x0").select(F.monotonically_increasing_id().alias("id"), "key", *ENDS)
    edges = materialise(spark, edges, "outline")
    links = materialise(spark, _followers(edges, True), "links")
    placed = lambda: materialise(spark, edges.join(traced(spark, links).hint("merge"), "id"), "passed")
    passed = placed()
    twice = passed.groupBy("key", "ring", "x0", "y0").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    twice = materialise(spark, twice.select("key", "ring", F.col("x0").alias("px"), F.col("y0").alias("py")), "twice")
    if not twice.isEmpty():
        at = lambda x, y: [F.col("key").eqNullSafe(F.col("k")), F.col("ring") == F.col("r"), F.col(x) == F.col("px"), F.col(y) == F.col("py")]
        t = twice.select(F.col("key").alias("k"), F.col("ring").alias("r"), "px", "py")
        near = passed.join(t, at("x1", "y1"), "left_semi").union(passed.join(t, at("x0", "y0"), "left_semi")).distinct()
        again = _followers(near, False, "ring").join(passed.join(t, at("x1", "y1"), "left_semi").select("id"), "id", "left_semi")
        again = materialise(spark, again, "again")
        links = materialise(spark, links.join(again.select("id"), "id", "left_anti").unionByName(again), "links")
        passed = placed()
    turns = links.select(F.col("next").alias("id"), "turns")
    placed = passed.join(turns.hint("merge"), "id").select("key", "ring", "seq", "x0", "y0", "turns", F.expr("x0 * y1 - x1 * y0").alias("a")).repartition("ring")
    area = placed.groupBy("ring").agg((F.sum("a") * snap * snap).alias("area2"))
    placed = placed.join(area.hint("merge"), "ring").select("key", "ring", "seq", (F.col("x0") * snap).alias("x"), (F.col("y0") * snap).alias("y"), "turns", "area2")
    return materialise(spark, placed, "rings")


def homes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices of rings and edges(key, ring, x0, y0, x1, y1) of the same -> ring, shell: a shell is its own, a hole belongs to the smallest shell round it."""
    shells = vertices.where("area2 > 0").groupBy("ring").agg(F.first("area2").alias("area2"))
    of = edges.join(shells.select("ring").hint("merge"), "ring", "left_semi").withColumn("w", F.lit(1))
    holes = edges.join(shells.select("ring").hint("merge"), "ring", "left_anti").groupBy("ring").agg(F.min(F.struct("key", *ENDS)).alias("e"))
    middle = holes.select(F.col("ring").alias("q"), "e.key", F.expr("case when e.y0 = e.y1 then 1 else 0 end").alias("mode"), F.expr("(e.x0 + e.x1) / 2").alias("x"), F.expr("(e.y0 + e.y1) / 2").alias("y"))
    inside = windings(middle, of).where("n <> 0").join(shells.hint("merge"), "ring")
    return shells.select("ring", F.col("ring").alias("shell")).union(inside.groupBy(F.col("q").alias("ring")).agg(F.min_by("ring", "area2").alias("shell")))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vertices sorted by key, shell, hole, ring and seq -> a multipolygon per key, which is one value."""
    now, parts, shell, ring = ..., [], None, None

    def out() -> pa.RecordBatch:
        closed = [[[*r, r[0]] for r in p] for p in parts]
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([wkb.dump("MultiPolygon", closed)], pa.binary())], ["key", "wkb"])

    for batch in batches:
        for key, of, r, x, y in zip(*[batch.column(c).to_pylist() for c in ("key", "shell", "ring", "x", "y")], strict=True):
            if key != now:
                if now is not ...:
                    yield out()
                now, parts, shell, ring = key, [], None, None
            if of != shell:
                parts.append([])
                shell = of
            if r != ring:
                parts[-1].append([])
                ring = r
            parts[-1][-1].append((x, y))
    if now is not ...:
        yield out()


def ring_edges(vertices: DataFrame) -> DataFrame:
    """vertices(key, ring, seq, x, y) of rings whose seq has no gaps -> key, ring, x0, y0, x1, y1."""
    size = vertices.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))
    after = vertices.select("ring", F.col("seq").alias("_s"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    at = vertices.join(size.hint("merge"), "ring").select("key", "ring", F.col("x").alias("x0"), F.col("y").alias("y0"), F.expr("(seq + 1) % n").alias("_s"))
    return at.join(after.hint("merge"), ["ring", "_s"]).select("key", "ring", *ENDS)


def shapes(vertices: DataFrame) -> DataFrame:
    """What `rings` gives, key a long -> key, wkb: one multipolygon per key, shells turning left, corners only."""
    of = homes(vertices, ring_edges(vertices))
    rows = vertices.where("turns").join(of, "ring").select("key", "shell", (F.col("ring") != F.col("shell")).alias("hole"), "ring", "seq", "x", "y")
    return rows.repartition("key").sortWithinPartitions("key", "shell", "hole", "ring", "seq").select("key", "shell", "ring", "x", "y").mapInArrow(_shapes, "key long, wkb binary")


def dissolved(spark: SparkSession, edges: DataFrame, snap: float = 1e-6) -> DataFrame:
    """edges(key, ring, x0, y0, x1, y1, w) -> vertices of the rings of each key's shape: polygons that overlap become one, rings that cross are put right."""
    return rings(spark, boundary(spark, edges, snap), snap)


def cell_outline(runs: DataFrame, *keys: str) -> DataFrame:
    """Disjoint runs (keys, cj, a, b), as long as can be -> key, x0, y0, x1, y1: the outline in cells, the shape at the left."""
    sides = runs.select(*keys, _rows("x0 y0 x1 y1", "a, cj + 1, a, cj", "b + 1, cj, b + 1, cj + 1").alias("e")).select(*keys, "e.*")
    # a row's lower line and the upper line of the row below lie on one line; what only one of them covers is outline
    ends = runs.select(*keys, _rows("y x m n", "cj, a, 1, 0", "cj, b + 1, -1, 0", "cj + 1, a, 0, 1", "cj + 1, b + 1, 0, -1").alias("e")).select(*keys, "e.*")
    ends = ends.groupBy(*keys, "y", "x").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "y").orderBy("x")  # the ends of the runs of two neighbouring rows
    upto = of.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = ends.select(*keys, "y", "x", F.lead("x").over(of).alias("next"), F.sum("m").over(upto).alias("m"), F.sum("n").over(upto).alias("n")).where("m <> n")
    flat = open_.select(*keys, F.expr("case when m > n then x else next end").alias("x0"), F.col("y").alias("y0"), F.expr("case when m > n then next else x end").alias("x1"), F.col("y").alias("y1"))
    return sides.unionByName(flat).select(*keys, *[F.col(c).cast("double").alias(c) for c in ENDS])


def cell_rings(spark: SparkSession, runs: DataFrame, c: float) -> DataFrame:
    """Runs of cells (key, cj, a, b) of size c -> the vertices of the rings of each key's shape."""
    return rings(spark, cell_outline(runs, "key"), c)
