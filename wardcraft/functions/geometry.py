"""Planar geometry as SQL expressions over coordinate columns. Each function gives the text of one expression.

A point is x, y; a segment x0, y0, x1, y1; a box is its two corners; a polyline is a table of segments
(line_id, seg_no, x0, y0, x1, y1, m0) with m0 the length before the segment. Distances up to a radius stand for
buffers, which differ from them only where a buffer's arc is drawn as a polygon.
"""

from __future__ import annotations


def param(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Where on a segment, from 0 to 1, the point's nearest place is; 0 on a segment without length."""
    dx, dy = f"({x1} - {x0})", f"({y1} - {y0})"
    length = f"({dx} * {dx} + {dy} * {dy})"
    return f"(CASE WHEN {length} = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, (({px} - {x0}) * {dx} + ({py} - {y0}) * {dy}) / {length})) END)"


def point_segment(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Distance of a point and a segment."""
    t = param(px, py, x0, y0, x1, y1)
    ex, ey = f"({px} - ({x0} + {t} * ({x1} - {x0})))", f"({py} - ({y0} + {t} * ({y1} - {y0})))"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


def point_box(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Distance of a point and a filled box."""
    dx, dy = f"greatest({x0} - {px}, 0e0, {px} - {x1})", f"greatest({y0} - {py}, 0e0, {py} - {y1})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def box_box(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    """Distance of two filled boxes."""
    dx, dy = f"greatest({a[0]} - {b[2]}, 0e0, {b[0]} - {a[2]})", f"greatest({a[1]} - {b[3]}, 0e0, {b[1]} - {a[3]})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def segment_meets_box(s: tuple[str, ...], b: tuple[str, ...]) -> str:
    """Whether a segment and a filled box have a point in common: the box clips the segment to a non-empty part."""
    (x0, y0, x1, y1), (a0, b0, a1, b1) = s, b
    dx, dy = f"({x1} - {x0})", f"({y1} - {y0})"
    low = lambda o, d, p, q: f"(CASE WHEN {d} = 0 THEN 0e0 ELSE least(({p} - {o}) / {d}, ({q} - {o}) / {d}) END)"
    high = lambda o, d, p, q: f"(CASE WHEN {d} = 0 THEN 1e0 ELSE greatest(({p} - {o}) / {d}, ({q} - {o}) / {d}) END)"
    flat = f"({dx} <> 0 OR ({x0} >= {a0} AND {x0} <= {a1})) AND ({dy} <> 0 OR ({y0} >= {b0} AND {y0} <= {b1}))"
    return f"({flat} AND greatest(0e0, {low(x0, dx, a0, a1)}, {low(y0, dy, b0, b1)}) <= least(1e0, {high(x0, dx, a0, a1)}, {high(y0, dy, b0, b1)}))"


def segment_box(s: tuple[str, ...], b: tuple[str, ...]) -> str:
    """Distance of a segment and a filled box: 0 if they meet, else from a corner or from an end."""
    (x0, y0, x1, y1), (a0, b0, a1, b1) = s, b
    corners = [point_segment(p, q, *s) for p in (a0, a1) for q in (b0, b1)]
    ends = [point_box(x0, y0, *b), point_box(x1, y1, *b)]
    return f"(CASE WHEN {segment_meets_box(s, b)} THEN 0e0 ELSE least({', '.join(corners + ends)}) END)"


def crosses_ray(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Whether a polygon's edge crosses the ray from the point to the right; a point is inside if an odd number do."""
    return f"((({y0} > {py}) <> ({y1} > {py})) AND {px} < ({x1} - {x0}) * ({py} - {y0}) / ({y1} - {y0}) + {x0})"


def segments_meet(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    """Whether two segments cross each other: the ends of each lie on different sides of the other. Mere touching is left to the distances of the ends."""
    side = lambda s, x, y: f"(({s[2]} - {s[0]}) * ({y} - {s[1]}) - ({s[3]} - {s[1]}) * ({x} - {s[0]}))"
    split = lambda s, t: f"{side(s, t[0], t[1])} * {side(s, t[2], t[3])} < 0"
    return f"({split(a, b)} AND {split(b, a)})"


def point_segment_squared(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """The square of the distance of a point and a segment, in few operations: from an end, or by the cross product."""
    dx, dy, ex, ey = f"({x1} - {x0})", f"({y1} - {y0})", f"({px} - {x0})", f"({py} - {y0})"
    dot, q = f"({ex} * {dx} + {ey} * {dy})", f"({dx} * {dx} + {dy} * {dy})"
    end, cross = f"(({px} - {x1}) * ({px} - {x1}) + ({py} - {y1}) * ({py} - {y1}))", f"({ex} * {dy} - {ey} * {dx})"
    return f"(CASE WHEN {dot} <= 0 THEN {ex} * {ex} + {ey} * {ey} WHEN {dot} >= {q} THEN {end} ELSE {cross} * {cross} / {q} END)"


def segment_segment(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    """Distance of two segments: 0 if they cross, else from an end of one to the other."""
    ends = [point_segment_squared(a[k], a[k + 1], *b) for k in (0, 2)] + [point_segment_squared(b[k], b[k + 1], *a) for k in (0, 2)]
    return f"(CASE WHEN {segments_meet(a, b)} THEN 0e0 ELSE sqrt(least({', '.join(ends)})) END)"


def _edge(name: str) -> tuple[str, ...]:
    return tuple(f"{name}.{c}" for c in ("x0", "y0", "x1", "y1"))


def inside(px: str, py: str, edges: str, e: str = "e") -> str:
    """Whether a point lies in a polygon, given as an array of the edges of all its rings. For Spark."""
    return f"(size(filter({edges}, {e} -> {crosses_ray(px, py, *_edge(e))})) % 2 = 1)"


def point_polygon(px: str, py: str, edges: str) -> str:
    """Distance of a point and a filled polygon. For Spark."""
    return f"(CASE WHEN {inside(px, py, edges)} THEN 0e0 ELSE sqrt(array_min(transform({edges}, e -> {point_segment_squared(px, py, *_edge('e'))}))) END)"


#: Radius of the sphere of EPSG:3857. Fixed value.
RADIUS = 6378137.0


def to_3857(lon: str, lat: str) -> tuple[str, str]:
    """x and y in EPSG:3857 of degrees."""
    return f"({RADIUS} * radians({lon}))", f"({RADIUS} * ln(tan(pi() / 4 + radians({lat}) / 2)))"
