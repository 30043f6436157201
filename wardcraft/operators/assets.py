"""Map features to the typed layers boundary, streets, nodes, addresses, main_buildings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcraft.functions import crs
from wardcraft.functions.numbers import housenumber_int
from wardcraft.functions.patterns import needed
from wardcraft.functions.text import normalize_street
from wardcraft.operators.cells import held
from wardcraft.plans.shared import materialise
from wardcraft.sources import wkb


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that aren't there, as nulls of the given types."""
    return df.withColumns({k: F.lit(None).cast(t) for k, t in columns.items() if k not in df.columns})


def rename_colons(df: DataFrame) -> DataFrame:
    """addr:street becomes addr_street, and so on."""
    return df.withColumnsRenamed({c: c.replace(":", "_") for c in df.columns if ":" in c})


def _replaced(df: DataFrame, names: tuple[str, ...], made: tuple[Column, ...]) -> DataFrame:
    """df with columns in place of those of the same names, computed once."""
    out = held(df, **{f"_new_{n}": m for n, m in zip(names, made, strict=True)})
    return out.drop(*names).withColumnsRenamed({f"_new_{n}": n for n in names}).select(*df.columns, *[n for n in names if n not in df.columns])


def reprojected(df: DataFrame, src: int, dst: int, x: str = "x", y: str = "y") -> DataFrame:
    """df with the coordinates of one system in another, in the same columns; in steps, as one expression would grow with each of them."""
    crs.is_geographic(src), crs.is_geographic(dst)
    if src == dst:
        return df
    columns, c, xyz = df.columns, F.col, ("_x", "_y", "_z")
    if src != 4326:
        df = _replaced(df, (x, y), crs.mercator_inverse(c(x), c(y)) if src == 3857 else crs.from_3844(c(x), c(y)))
    if 3844 in (src, dst):
        own = (crs.A, crs.F_INV)
        before, after = (own, crs.WGS84) if src == 3844 else (crs.WGS84, own)
        df = _replaced(df, xyz, crs.geocentric(c(x), c(y), *before))
        df = _replaced(df, xyz, crs.shifted(*map(c, xyz), back=dst == 3844))
        df = _replaced(df, (x, y), crs.geodetic(*map(c, xyz), *after)).drop(*xyz)
    if dst != 4326:
        df = _replaced(df, (x, y), crs.mercator(c(x), c(y)) if dst == 3857 else crs.to_3844(c(x), c(y)))
    return df.select(columns)


def first_available(df: DataFrame, names: tuple[str, ...]) -> str:
    """The first of the names that is a column; ValueError if none is."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {names} in {df.columns}")


#: Fixed values, as the next.
STREET_NAMES = ("name", "addr_street", "street", "str_name", "road_name")


def feature_id(kind: Column, osmid: Column) -> Column:
    """way:12 and the like; the bare id where there is no kind."""
    return F.when(kind.isNull(), osmid.cast("string")).otherwise(F.concat_ws(":", kind, osmid.cast("string")))


def source_class(kind: Column) -> Column:
    return F.when(kind == "node", "node").when(kind.isin("way", "relation"), "building").otherwise("other")


def with_surrogate_id(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Numbered from 0 in this order, which should be unique, without bringing all rows into one task: row counts of sorted ranges are added up."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() % (1 << 33))
    ranged = materialise(df.sparkSession, ranged, "numbered")
    counts = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}  # a row per task
    at, before = 0, []
    for p in sorted(counts):
        before += [F.lit(p), F.lit(at).cast("long")]
        at += counts[p]
    start = F.element_at(F.create_map(*before), F.col("_p")) if before else F.lit(0).cast("long")
    return ranged.withColumn(name, start + F.col("_k")).drop("_p", "_k")


def street_named(streets: DataFrame, name: str, norm=normalize_street) -> DataFrame:
    """Streets whose normalised name equals the wanted one, else those in which it is found as a pattern (as plain text, if it is none); ValueError with up to 20 names if there is none."""
    column = first_available(streets, STREET_NAMES)
    named = streets.withColumn("street_norm", norm(F.col(column)))
    wanted = norm(F.lit(name))
    pattern = streets.sparkSession.range(1).select(wanted).first()[0]
    within = F.col("street_norm").contains(wanted) if needed(pattern) is None else F.col("street_norm").rlike(pattern)
    for test in (F.col("street_norm") == wanted, within):
        found = named.where(test)
        if not found.isEmpty():
            return found
    sample = [r[0] for r in streets.select(column).where(F.col(column).isNotNull()).limit(20).collect()]
    raise ValueError(f"no street {name!r}; some names: {sample}")


def flatten_list(c: Column) -> Column:
    """Comma-joined; null stays null."""
    return F.when(c.isNotNull(), F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))))


def length_column(df: DataFrame, computed: Column) -> Column:
    """The length column as a number (null where it isn't one) if the table has it, else the computed one for all rows."""
    return F.col("length").try_cast("double") if "length" in df.columns else computed


#: Geometry types of polygon layers. Fixed values.
POLYGONS = ("Polygon", "MultiPolygon")


def pick_boundary_layer(layers: DataFrame) -> DataFrame:
    """layers(ord, name, geom_type): the first polygon layer with boundary in its name, else the first polygon layer; the query fails with a message if there is none."""
    polygons = layers.where(F.col("geom_type").isin(*POLYGONS))
    found = polygons.agg(F.min_by("name", F.struct((~F.lower("name").contains("boundary")).cast("int"), "ord")).alias("name"))
    return found.select(F.coalesce("name", F.raise_error(F.lit("no polygon layer")).cast("string")).alias("name"))


def boundary_layer_name(layers: DataFrame) -> str:
    """The name that pick_boundary_layer finds; ValueError if there is no polygon layer."""
    row = layers.where(F.col("geom_type").isin(*POLYGONS)).agg(F.min_by("name", F.struct((~F.lower("name").contains("boundary")).cast("int"), "ord")).alias("name")).first()
    if row.name is None:
        raise ValueError("no polygon layer")
    return row.name


#: Layers by which the reference system is picked. Fixed values.
CRS_ORDER = ("main_streets", "streets", "main_roads", "roads")


def pick_reference_crs(layers: DataFrame, boundary_crs: str | None) -> DataFrame:
    """layers(name, crs): the system of the first of CRS_ORDER that has one, else the boundary's, else EPSG:4326."""
    rank = F.when(F.lit(False), 0)
    for k, name in enumerate(CRS_ORDER):
        rank = rank.when(F.col("name") == name, k)
    found = layers.withColumn("rank", rank).where("rank is not null and crs is not null").agg(F.min_by("crs", "rank").alias("crs"))
    return found.select(F.coalesce("crs", F.lit(boundary_crs).cast("string"), F.lit("EPSG:4326")).alias("crs"))


def addresses_layer(features: DataFrame) -> DataFrame:
    """features(etype, osmid, geom_type, x, y, tags map) -> addr_id, addr_street, addr_housenumber, addr_housenumber_int, source, x, y.

    Only features with a house number whose place is a point; polygons come with an inner point already.
    """
    number = F.col("tags").getItem("addr:housenumber")
    rows = features.where(number.isNotNull() & F.col("geom_type").isin("Point", "Polygon", "MultiPolygon"))
    return rows.select(feature_id(F.col("etype"), F.col("osmid")).alias("addr_id"), F.col("tags").getItem("addr:street").alias("addr_street"), number.alias("addr_housenumber"), housenumber_int(number).alias("addr_housenumber_int"), source_class(F.col("etype")).alias("source"), "x", "y")


def _lines(batches):
    for batch in batches:
        found = [wkb.dump("LineString", [(p["x"], p["y"]) for p in x]) if x else None for x in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["path"]).columns, pa.array(found, pa.binary())], [*batch.drop_columns(["path"]).schema.names, "wkb"])


def streets_layer(edges: DataFrame) -> DataFrame:
    """edges(u, v, key, osmid array, tags ..., length in metres?) -> u, v, key, osmid, name, highway, oneway, length_m and the geometry: x0, y0, x1, y1, or of contracted edges wkb.

    Lists are joined by commas. Without a length it is that of the coordinates, which then have to be in a metric system.
    """
    e = with_missing(edges, {"name": "string", "highway": "string", "oneway": "string", "x0": "double", "y0": "double", "x1": "double", "y1": "double"})
    computed = F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))")
    flat = lambda c: (F.nullif(flatten_list(F.col(c)), F.lit("")) if dict(e.dtypes)[c].startswith("array") else F.col(c).cast("string")).alias(c)
    columns = ["u", "v", "key", flat("osmid"), flat("name"), flat("highway"), flat("oneway"), length_column(e, computed).alias("length_m")]
    if "path" not in e.columns:
        return e.select(*columns, "x0", "y0", "x1", "y1")
    kinds = "u long, v long, key int, osmid string, name string, highway string, oneway string, length_m double, wkb binary"
    return e.select(*columns, "path").mapInArrow(_lines, kinds)


def nodes_layer(nodes: DataFrame) -> DataFrame:
    return with_missing(nodes, {"street_count": "int"}).select("osmid", "x", "y", "street_count")


def buildings_layer(features: DataFrame) -> DataFrame:
    """Polygon features tagged as buildings: building, name, addr_housenumber, addr_street, osm_id, wkb."""
    tag = lambda k: F.col("tags").getItem(k)
    rows = features.where(tag("building").isNotNull() & F.col("geom_type").isin("Polygon", "MultiPolygon"))
    out = rows.select(tag("building").alias("building"), tag("name").alias("name"), tag("addr:housenumber").alias("addr:housenumber"), tag("addr:street").alias("addr:street"), feature_id(F.col("etype"), F.col("osmid")).alias("osm_id"), "wkb")
    return rename_colons(out)


def boundary_layer(parts: DataFrame, name: str, source: str = "extract") -> DataFrame:
    """One row of name, source and the bounds of all parts (x0, y0, x1, y1)."""
    box = parts.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return box.select(F.lit(name).alias("name"), F.lit(source).alias("source"), "x0", "y0", "x1", "y1")
