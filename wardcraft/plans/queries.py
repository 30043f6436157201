"""The queries of the rule, address, layer and geometry operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.functions import text
from wardcraft.functions.geometry import to_3857
from wardcraft.functions.numbers import covers, housenumber_cover, housenumber_int
from wardcraft.functions.rules import rule_parts, rule_ranges, rule_singles
from wardcraft.operators import assets, cells, graph, match, overlay, polygons, sections, spatial
from wardcraft.plans.shared import materialise
from wardcraft.plans.views import view
from wardcraft.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RADIUS, CELL, DISC, CORRIDOR, GROW = 40.0, 5.0, 10.0, 12.0, 18.0


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _long(name: str):
    return F.col(name).cast("long").alias(name)


# text ------------------------------------------------------------------------------------------


@query
def normalize_street(spark, sf):
    return view(spark, sf, "v_addr").select("row_id", text.normalize_street(F.col("addr_street")).alias("norm"))


@query
def normalize_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.md5(text.normalize_street(F.col("text"))).alias("norm_md5"))


@query
def weak_norm(spark, sf):
    return view(spark, sf, "v_addr").select("row_id", text.weak_norm(F.col("addr_street")).alias("norm"))


@query
def slug(spark, sf):
    return view(spark, sf, "v_addr").select("row_id", text.slug(F.col("addr_street")).alias("slug"))


@query
def safe_str_int(spark, sf):
    return view(spark, sf, "v_rsv").select("row_id", text.safe_str(F.col("adresa_sv_descriptiva")).alias("s"), text.safe_int(F.col("cod_artera")).alias("i"), text.to_number(F.col("nr_sv")).alias("n"))


@query
def num_token(spark, sf):
    return view(spark, sf, "v_addr").select("row_id", text.num_token(F.col("addr_housenumber")).alias("token"))


# house numbers and rules -------------------------------------------------------------------------


@query
def hn_info(spark, sf):
    return view(spark, sf, "v_addr").select("row_id", housenumber_cover(F.col("addr_housenumber")).alias("c")).select("row_id", "c.lo", "c.hi", _step(), "c.inferred", "c.is_range")


def _step():
    return F.col("c.step").cast("long").alias("step")


@query
def hn_int(spark, sf):
    return view(spark, sf, "v_addr").select("row_id", housenumber_int(F.col("addr_housenumber")).alias("n"))


@query
def hn_covers_range(spark, sf):
    """Each address against an odd range, an even reversed range with a void one, and singles."""
    a = view(spark, sf, "v_addr").select("row_id", housenumber_cover(F.col("addr_housenumber")).alias("c"))
    ranges = lambda *r: F.array(*[F.struct(F.lit(x).alias("start"), F.lit(y).alias("end")) for x, y in r]) if r else F.array().cast("array<struct<start:string,end:string>>")
    singles = lambda *s: F.array(*[F.lit(x) for x in s]).cast("array<string>")
    test = lambda p, r, s: covers(F.col("c"), F.lit(p).cast("string"), ranges(*r), singles(*s))
    return a.select("row_id", test("odd", [("11", "29")], []).alias("odd"), test("even", [("30", "8"), ("1", "2 B")], []).alias("even"), test(None, [], ["7", "12", "9 A"]).alias("singles"), test("odd", [("1", "x")], []).alias("void"))


@query
def rule_split(spark, sf):
    return view(spark, sf, "v_rsv").select("row_id", F.posexplode(rule_parts(F.col("numar_imobil"))).alias("part_no", "part")).select("row_id", _long("part_no"), "part")


def _parts(spark, sf):
    return view(spark, sf, "v_rsv").select("row_id", F.posexplode(rule_parts(F.col("numar_imobil"))).alias("part_no", "part")).withColumn("part_no", _long("part_no"))


def _joined_ranges(c):
    return F.array_join(F.transform(c, lambda r: F.concat(r["start"], F.lit("~"), r["end"])), ";")


@query
def rule_ranges_all(spark, sf):
    return _parts(spark, sf).select("row_id", "part_no", _joined_ranges(rule_ranges(F.col("part"))).alias("ranges"))


@query
def rule_singles_all(spark, sf):
    return _parts(spark, sf).select("row_id", "part_no", F.array_join(rule_singles(F.col("part")), ";").alias("singles"))


def _rules(spark, sf):
    return sections.section_rules(sections.segment_blocks(view(spark, sf, "v_rsv")))


@query
def rule_parse_flat(spark, sf):
    specs = sections.flat_specs(_rules(spark, sf))
    return specs.select("judet", "sv", "row_id", _long("spec_no"), "street_norm", "kind", "parity", _joined_ranges(F.col("ranges")).alias("ranges"), F.array_join("singles", ";").alias("singles"))


@query
def sv_ffill(spark, sf):
    return sections.segment_blocks(view(spark, sf, "v_rsv")).select("row_id", "judet", "sv")


@query
def event_ffill(spark, sf):
    """The same fill over events: the last sign-up of each of five streams."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(F.col("event_id").alias("row_id"), (F.col("user_id") % 5).cast("string").alias("judet"), F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")).alias("nr_sv"))
    return sections.segment_blocks(rows).select("row_id", "judet", "sv")


@query
def sv_header(spark, sf):
    return sections.headers(sections.segment_blocks(view(spark, sf, "v_rsv")))


@query
def sv_rules(spark, sf):
    nested = sections.parse_sections(view(spark, sf, "v_rsv"))
    one = nested.select("judet", "sv", F.posexplode("rules").alias("rule_no", "r"))
    return one.select("judet", "sv", _long("rule_no"), "r.cod_artera", "r.street", "r.raw", F.size("r.specs").cast("long").alias("n_specs"))


@query
def sv_notes(spark, sf):
    return sections.section_notes(sections.segment_blocks(view(spark, sf, "v_rsv")))


@query
def sv_notes_lag(spark, sf):
    return sections.section_notes(sections.segment_blocks(view(spark, sf, "v_rsv")), previous_text=True)


@query
def sections_json(spark, sf):
    return sinks.sections_json(sections.parse_sections(view(spark, sf, "v_rsv")))


# matching ----------------------------------------------------------------------------------------


def _specs(spark, sf):
    return sections.flat_specs(_rules(spark, sf))


@query
def equi_match(spark, sf):
    norms = _specs(spark, sf).select(F.col("street_norm").alias("rule_norm")).distinct()
    streets = view(spark, sf, "v_addr").select(text.normalize_street(F.col("addr_street")).alias("street_norm")).distinct()
    return norms.join(streets, norms.rule_norm == streets.street_norm).select("rule_norm")


@query
def fallback_match(spark, sf):
    norms = _specs(spark, sf).select(F.col("street_norm").alias("rule_norm")).distinct()
    streets = view(spark, sf, "v_addr").select(text.normalize_street(F.col("addr_street")).alias("street_norm")).distinct()
    return match.street_links(norms, streets).where("rule_norm <> street_norm")


@query
def match_pairs(spark, sf):
    found = match.match_rows(_specs(spark, sf), match.prepare_addresses(view(spark, sf, "v_addr")), columns=("judet", "sv", "rule_no", "spec_no", "addr_id"))
    return found.select("judet", "sv", "rule_no", _long("spec_no"), "addr_id")


def _matched(spark, sf, specs):
    addresses = view(spark, sf, "v_addr").withColumn("addr_housenumber_int", housenumber_int(F.col("addr_housenumber")))
    return match.match_addresses(specs, addresses).select("judet", "sv", "addr_id", "addr_street", "addr_housenumber", "addr_housenumber_int", "street_norm")


@query
def match_all(spark, sf):
    return _matched(spark, sf, _specs(spark, sf))


@query
def match_one(spark, sf):
    return _matched(spark, sf, _specs(spark, sf).where("judet = 'B' and sv = 2"))


@query
def dedupe_address(spark, sf):
    return match.dedupe_by_address(match.prepare_addresses(view(spark, sf, "v_addr"))).select("street_norm", "addr_housenumber_int", "addr_id")


@query
def dedupe_no_id(spark, sf):
    rows = match.prepare_addresses(view(spark, sf, "v_addr"))
    return match.dedupe_by_address(rows, id_col=None, order=("row_id",)).select("street_norm", "addr_housenumber_int", "row_id")


@query
def report_sorted(spark, sf):
    return sinks.report(match_all(spark, sf)).withColumns({"place": _long("place"), "place_by_text": _long("place_by_text")})


# layers ------------------------------------------------------------------------------------------


@query
def id_source(spark, sf):
    e = view(spark, sf, "v_edge_raw")
    return e.select("osmid", assets.feature_id(F.col("etype"), F.col("osmid")).alias("id"), assets.source_class(F.col("etype")).alias("source"))


@query
def list_flatten(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    lists = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("ids"))
    return lists.select(_long("n_regionkey"), assets.flatten_list(F.when(F.col("n_regionkey") != 2, F.col("ids"))).alias("ids"))


@query
def length_fallback(spark, sf):
    e = view(spark, sf, "v_edge_raw")
    with_it = e.select("osmid", assets.length_column(e, F.lit(-1.0)).alias("own"))
    without = e.drop("length")
    return with_it.join(without.select("osmid", assets.length_column(without, F.lit(-1.0)).alias("computed")), "osmid")


@query
def missing_and_renamed(spark, sf):
    e = view(spark, sf, "v_edge_raw").withColumnRenamed("etype", "addr:type")
    out = assets.rename_colons(assets.with_missing(e, {"highway": "string", "length": "string"}))
    return out.select("osmid", "addr_type", "highway", assets.first_available(out, ("name", "addr_street", "length"))).withColumnRenamed("length", "picked")


@query
def crs_pick(spark, sf):
    return assets.pick_reference_crs(view(spark, sf, "v_layers"), "EPSG:9999")


@query
def boundary_pick(spark, sf):
    return assets.pick_boundary_layer(view(spark, sf, "v_layers"))


# geometry ----------------------------------------------------------------------------------------


def _rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n), 4) for n in names})


@query
def bbox(spark, sf):
    return spatial.bounds(view(spark, sf, "v_pt"), "key")


@query
def mercator(spark, sf):
    lon, lat = "(x / 10e0 + 20)", "(y / 40e0 + 40)"
    x, y = to_3857(lon, lat)
    return view(spark, sf, "v_pt").select("pt_id", F.round(F.expr(x), 3).alias("mx"), F.round(F.expr(y), 3).alias("my"))


@query
def stereo70(spark, sf):
    """Degrees of 4326 in 3844, datum shift included, to the centimetre."""
    places = view(spark, sf, "v_pt").select("pt_id", F.expr("x / 150e0 + 21").alias("x"), F.expr("y / 150e0 + 44").alias("y"))
    return assets.reprojected(places, 4326, 3844).select("pt_id", F.round("x", 2).alias("sx"), F.round("y", 2).alias("sy"))


def _segments(spark, sf):
    return spatial.segments_of(view(spark, sf, "v_vert"))


@query
def line_length(spark, sf):
    s = _segments(spark, sf)
    return _rounded(s.groupBy("line_id").agg(F.max(F.expr("m0 + sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))")).alias("len"), F.count(F.lit(1)).alias("n")), "len")


@query
def longest_part(spark, sf):
    s = _segments(spark, sf).selectExpr("line_id", "cast(seg_no as bigint) as part_no", "round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 4) as len")
    return spatial.longest_part(s)


@query
def poly_area_centroid(spark, sf):
    return _rounded(spatial.ring_measures(view(spark, sf, "v_edge")), "area", "cx", "cy")


@query
def pip_count(spark, sf):
    inside = spatial.points_in_polygons(view(spark, sf, "v_pt"), view(spark, sf, "v_edge"))
    return inside.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"))


@query
def project_measure(spark, sf):
    return _rounded(spatial.measures(view(spark, sf, "v_pt"), _segments(spark, sf)), "d", "m")


@query
def interpolate_samples(spark, sf):
    s = _segments(spark, sf)
    return _rounded(spatial.samples(spatial.measures(view(spark, sf, "v_pt"), s), s).withColumn("i", _long("i")), "m", "x", "y")


def _corridor(spark, sf):
    return materialise(spark, spatial.meeting(view(spark, sf, "v_bld"), _segments(spark, sf), CORRIDOR), "corridor")


@query
def corridor_semijoin(spark, sf):
    return _corridor(spark, sf).select("bld_id")


@query
def knn_seed(spark, sf):
    return _rounded(spatial.nearest(view(spark, sf, "v_pt"), view(spark, sf, "v_bld"), RADIUS).select("pt_id", "n_square", "bld_id", "d"), "d")


@query
def knn_reject_reason(spark, sf):
    found = spatial.seeds(view(spark, sf, "v_pt"), view(spark, sf, "v_bld"), _corridor(spark, sf), 6.0)
    return found.select("pt_id", F.regexp_replace(F.coalesce("reason", F.lit("seed")), r" \(.*", "").alias("reason"))


@query
def grow_semijoin(spark, sf):
    b, corridor = view(spark, sf, "v_bld"), _corridor(spark, sf)
    seed = spatial.seeds(view(spark, sf, "v_pt"), b, corridor, 6.0).where("reason is null").select("bld_id").distinct()
    return spatial.grown(corridor, b.join(seed, "bld_id", "left_semi"), GROW).select("bld_id")


def _discs(spark, sf):
    return cells.buffer_points(view(spark, sf, "v_pt"), DISC, CELL, "key")


def _tube(spark, sf):
    lines = _segments(spark, sf).withColumnRenamed("line_id", "key")
    return cells.buffer_segments(lines, CORRIDOR, CELL, "key")


@query
def cell_union(spark, sf):
    return cells.area(cells.union(_discs(spark, sf), _tube(spark, sf)), CELL, "key")


@query
def cell_intersect(spark, sf):
    return cells.area(cells.intersect(_discs(spark, sf), _tube(spark, sf), "key"), CELL, "key")


@query
def cell_difference(spark, sf):
    return cells.area(cells.difference(_tube(spark, sf), _discs(spark, sf), "key"), CELL, "key")


@query
def cell_largest_part(spark, sf):
    return cells.area(cells.largest_part(spark, cells.difference(_tube(spark, sf), _discs(spark, sf), "key")), CELL, "key")


def _boundary(spark):
    corners = [(0.0, 0.0), (950.0, 0.0), (900.0, 390.0), (0.0, 390.0)]
    return spark.createDataFrame([(*p, *q) for p, q in zip(corners, [*corners[1:], corners[0]], strict=True)], "x0 double, y0 double, x1 double, y1 double")


def _houses(spark, sf):
    return spatial.polygons_of(view(spark, sf, "v_bedge"))


@query
def knn_polygon(spark, sf):
    return _rounded(spatial.nearest(view(spark, sf, "v_pt"), _houses(spark, sf), RADIUS).select("pt_id", "n_square", "bld_id", "d"), "d")


@query
def corridor_polygon(spark, sf):
    return spatial.meeting(_houses(spark, sf), _segments(spark, sf), CORRIDOR).select("bld_id")


@query
def grow_polygon(spark, sf):
    houses = _houses(spark, sf)
    return spatial.grown(houses, houses.where("bld_id % 97 = 0"), GROW).select("bld_id")


@query
def near_parts(spark, sf):
    """Stretches of the lines within 1.5 of any of their points."""
    return _rounded(spatial.near_points(view(spark, sf, "v_pt"), _segments(spark, sf), 1.5), "a", "b")


@query
def cell_polygon(spark, sf):
    return cells.area(cells.fill_rings(view(spark, sf, "v_edge"), CELL, "poly_id"), CELL, "poly_id")


@query
def polygon_v1_cells(spark, sf):
    return cells.area(polygons.corridor_side(spark, view(spark, sf, "v_pt"), _houses(spark, sf), _segments(spark, sf), _boundary(spark)), CELL, "key")


@query
def polygon_v3_cells(spark, sf):
    return cells.area(polygons.seeds_and_strip(spark, view(spark, sf, "v_pt"), _houses(spark, sf), _segments(spark, sf), _boundary(spark)), CELL, "key")


# outlines, overlay and graphs --------------------------------------------------------------------


def _ring_counts(vertices):
    """Per key: area, corners, length of the outline; and euler, shells less holes, where a hole that touches its shell at a corner isn't one."""
    edges = overlay.ring_edges(vertices)
    length = edges.groupBy("key").agg(F.round(F.sum(F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))")), 3).alias("perimeter"))
    rings = vertices.groupBy("key", "ring").agg(F.first("area2").alias("a"), F.count_if("turns").alias("n"))
    counts = rings.groupBy("key").agg(F.round(F.sum("a") / 2, 3).alias("area"), F.sum("n").alias("corners"), F.sum(F.when(F.col("a") > 0, 1).otherwise(-1)).alias("s"))
    touching = vertices.join(overlay.homes(vertices, edges).hint("merge"), "ring").groupBy("key", "shell", "x", "y").agg((F.count(F.lit(1)) - 1).alias("t")).groupBy("key").agg(F.sum("t").alias("t"))
    return counts.join(touching.hint("merge"), "key").join(length.hint("merge"), "key").select("key", "area", "corners", (F.col("s") + F.col("t")).alias("euler"), "perimeter")


@query
def cell_rings(spark, sf):
    """Outlines of the bands of all roads, less the discs round every point: per road, what its rings measure."""
    roads = spatial.segments_of(view(spark, sf, "v_road")).withColumnRenamed("line_id", "key")
    discs = cells.buffer_points(view(spark, sf, "v_pt").select((F.col("pt_id") % 40).alias("key"), "x", "y"), DISC, CELL, "key")
    return _ring_counts(overlay.cell_rings(spark, cells.difference(cells.buffer_segments(roads, CORRIDOR, CELL, "key"), discs, "key"), CELL))


def _box_edges(boxes, *keys):
    return polygons._edges(boxes, *keys).withColumnRenamed("bld_id", "ring")


@query
def dissolve_boxes(spark, sf):
    """Buildings of 16 sections as one shape each."""
    edges = _box_edges(view(spark, sf, "v_bld").withColumn("key", F.col("bld_id") % 16), "key")
    return _ring_counts(overlay.dissolved(spark, overlay.oriented(edges)))


@query
def repair_bowties(spark, sf):
    """Rings that cross themselves, put right one by one: what lies on the inner side of their highest corner stays."""
    edges = view(spark, sf, "v_bow").withColumn("key", F.col("ring"))
    return _ring_counts(overlay.dissolved(spark, overlay.oriented(edges), snap=1e-9)).select("key", "area", "corners", "euler")


@query
def street_directed(spark, sf):
    return graph.directed(view(spark, sf, "v_piece")).select("u", "v", _long("key"), "osmid", "reversed")


@query
def street_simplified(spark, sf):
    found = graph.simplified(spark, graph.directed(view(spark, sf, "v_piece")))
    return found.select("u", "v", "n_pieces", "length", assets.flatten_list(F.array_sort("osmid")).alias("osmid"))


@query
def long_line_measure(spark, sf):
    """Places along five lines that grow with the table."""
    lines = spatial.segments_of(view(spark, sf, "v_long"))
    return _rounded(spatial.measures(view(spark, sf, "v_pt"), lines), "d", "m")


@query
def lines_in_polygons(spark, sf):
    """Which roads have a place in which polygons."""
    roads = spatial.segments_of(view(spark, sf, "v_road")).select(F.col("line_id").alias("id"), F.lit(False).alias("area"), "x0", "y0", "x1", "y1")
    return spatial.meeting_polygons(roads, view(spark, sf, "v_edge"))


@query
def houses_in_polygons(spark, sf):
    """Which buildings have a place in which polygons."""
    houses = view(spark, sf, "v_bedge").select(F.col("bld_id").alias("id"), F.lit(True).alias("area"), "x0", "y0", "x1", "y1")
    return spatial.meeting_polygons(houses, view(spark, sf, "v_edge"))
