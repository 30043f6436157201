"""Street graphs: a directed multigraph of road pieces, its largest component, and chains of pieces contracted between true crossings.

Tables: pieces(osmid, pos, u, v, oneway, length, ...), one row per pair of neighbouring nodes of a way; edges(u, v, key, ...), directed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardcraft.plans.components import connected_components
from wardcraft.plans.lists import ranked
from wardcraft.plans.shared import materialise

#: Values of the tag oneway. Fixed values.
FORWARD, BACKWARD = ("yes", "true", "1"), ("-1", "reverse")
_ENDS = {"u": "v", "v": "u", "x0": "x1", "y0": "y1", "x1": "x0", "y1": "y0"}


def directed(pieces: DataFrame, roundabout: Column | None = None) -> DataFrame:
    """pieces -> edges with `reversed` and key: a piece both ways unless it is one-way, forward or (-1) backward; roundabouts are one-way.

    key numbers the edges from u to v, by way and place, from 0: (u, v, key) is unique. Ends without an id go.
    """
    tag = F.lower(F.trim("oneway"))
    forward = F.coalesce(tag.isin(*FORWARD), F.lit(False)) | (F.lit(False) if roundabout is None else F.coalesce(roundabout, F.lit(False)) & ~F.coalesce(tag.isin(*BACKWARD, "no"), F.lit(False)))
    backward = F.coalesce(tag.isin(*BACKWARD), F.lit(False))
    ways = F.when(forward, F.array(F.lit(False))).when(backward, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    both = pieces.where("u is not null and v is not null").withColumn("reversed", F.explode(ways))
    turned = both.select(*[F.when(F.col("reversed"), F.col(_ENDS[c])).otherwise(F.col(c)).alias(c) if c in _ENDS else F.col(c) for c in both.columns])
    return turned.withColumn("key", F.row_number().over(Window.partitionBy("u", "v").orderBy("osmid", "pos", "reversed")) - 1)  # the edges between two nodes


def truncated(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges of which an end is one of the nodes inside(osmid): what crosses a boundary stays whole."""
    nodes = inside.select(F.col("osmid").alias("n")).distinct()
    ends = edges.select("u", "v").distinct()
    kept = ends.join(nodes, F.col("u") == F.col("n"), "left_semi").union(ends.join(nodes, F.col("v") == F.col("n"), "left_semi")).distinct()
    return edges.join(kept, ["u", "v"], "left_semi")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), directions aside."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = connected_components(spark, edges.select("u", "v").where("u <> v")).select(F.col("node").alias("n"), "root")
    return nodes.join(found, F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("component"))


def largest_component(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes, that of the smallest node on a tie."""
    found = materialise(spark, components(spark, edges), "components")
    best = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    kept = found.join(best, "component", "left_semi").select(F.col("node").alias("u"))
    return edges.join(kept, "u", "left_semi")


def crossings(edges: DataFrame) -> DataFrame:
    """node, crossing: false for nodes that a road only passes: two neighbours, with one edge in from one and out to the other, or such edges both ways."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), F.lit(1).alias("out")).union(edges.select("v", "u", F.lit(0)))
    by = ends.groupBy("node", "other").agg(F.sum("out").alias("o"), F.sum(1 - F.col("out")).alias("i"))
    n = by.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.max(F.greatest("o", "i")).alias("most"), F.sum(F.col("o") - F.col("i")).alias("more"), F.max(F.expr("other = node")).alias("loop"))
    return n.select("node", F.expr("loop or k <> 2 or most > 1 or more <> 0").alias("crossing"))


def simplified(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges(u, v, key, osmid, length, name, highway, oneway, x0, y0, x1, y1; what there is of these) -> u, v, key, osmid, n_pieces, length, ... and path, of contracted edges.

    A chain of pieces between crossings is one edge; its length is the sum, its osmid, name, highway and oneway are the different values in
    order, its path the places in order. Chains are ranked by doubling (`ranked`), so none passes through one task but as its one row. A ring
    without a crossing stays as it is.
    """
    e = materialise(spark, edges.repartitionByRange("u").select(F.monotonically_increasing_id().alias("id"), "*"), "pieces")  # nodes that follow each other mostly share a task
    passing = crossings(e).where("not crossing").select(F.col("node").alias("v"))
    on = e.join(passing, "v", "left_semi").select("id", "u", "v")
    after = e.select(F.col("id").alias("next"), F.col("u").alias("v"), F.col("v").alias("w"))
    # a passed node has two neighbours, so what leaves it and doesn't go back is one edge
    follow = on.join(after, "v").where("w <> u").select("id", "next")
    links = e.select("id").join(follow, "id", "left")
    found = ranked(spark, links)
    kept = [c for c in ("osmid", "name", "highway", "oneway") if c in e.columns]
    placed = e.join(found, "id", "left").select("*", F.coalesce("list", "id").alias("of"), F.coalesce("seq", F.lit(0).cast("long")).alias("at"))
    first, last = F.min_by(F.struct("u", *[c for c in ("x0", "y0") if c in e.columns]), "at"), F.max_by("v", "at")
    lists = [F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("x")))).alias(f"_{c}") for c in kept]
    path = [F.array_sort(F.collect_list(F.struct("at", F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("_path")] if "x0" in e.columns else []
    out = placed.groupBy("of").agg(first.alias("f"), last.alias("v"), F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("length"), *lists, *path)
    different = lambda c: F.array_distinct(F.transform(F.filter(F.col(f"_{c}"), lambda x: x["x"].isNotNull()), lambda x: x["x"])).alias(c)
    points = [F.concat(F.array(F.struct(F.col("f.x0").alias("x"), F.col("f.y0").alias("y"))), F.transform("_path", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("path")] if path else []
    out = out.select(F.col("f.u").alias("u"), "v", "of", "n_pieces", "length", *[different(c) for c in kept], *points)
    return out.withColumn("key", F.row_number().over(Window.partitionBy("u", "v").orderBy("of")) - 1).drop("of")


def street_graph(spark: SparkSession, pieces: DataFrame, simplify: bool = True, retain_all: bool = False, inside: DataFrame | None = None) -> DataFrame:
    """pieces with roundabout, lengths and places -> the edges of the street graph: directed, cut to what has an end in `inside`(osmid), its largest component, contracted."""
    edges = directed(pieces, F.col("roundabout"))
    edges = edges if inside is None else truncated(edges, inside)
    edges = edges if retain_all else largest_component(spark, edges)
    return simplified(spark, edges) if simplify else edges


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Edges of street_graph -> osmid, x, y, street_count: the ends of edges and how many streets meet there, both ways of one counted once, a loop twice."""
    path = "path" in edges.columns
    at = [F.element_at("path", 1) if path else F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.element_at("path", -1) if path else F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))]
    street = F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), (F.array_sort("osmid") if path else F.col("osmid")).alias("osmid"), F.round("length", 3).alias("length"))
    flat = edges.select(street.alias("street"), "u", "v", at[0].alias("p"), at[1].alias("q"))
    ends = flat.select("street", F.explode(F.expr("array(struct(u as osmid, p as p, 0 as end), struct(v as osmid, q as p, 1 as end))")).alias("n"))
    of = ends.select("n.osmid", "n.p", "street", F.when(F.col("street.a") == F.col("street.b"), F.col("n.end")).alias("end"))
    return of.groupBy("osmid").agg(F.min("p").alias("p"), F.count_distinct(F.struct("street", "end")).cast("int").alias("street_count")).select("osmid", "p.x", "p.y", "street_count")
