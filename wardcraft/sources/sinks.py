"""Layers as Parquet folders, metadata and section records as JSON, the console report."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_layer(df: DataFrame, folder: str, layer: str) -> None:
    """One folder per layer: replacing one keeps the others."""
    df.write.mode("overwrite").parquet(f"{folder}/{layer}")


def read_layer(spark: SparkSession, folder: str, layer: str) -> DataFrame:
    """A layer; ValueError if it has no rows."""
    df = spark.read.parquet(f"{folder}/{layer}")
    if df.isEmpty():
        raise ValueError(f"layer {layer} is empty")
    return df


def metadata(points: DataFrame, city: str, query: str, crs: int, layers: list[str], network: dict, package: str) -> dict:
    """The record of an asset build; its bounds are aggregated from x and y. network: network_type, simplify, retain_all."""
    b = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return {"city": city, "place_query": query, "crs_epsg": crs, **network, "generated_at_utc": datetime.now(UTC).isoformat(), "assets_gpkg": package, "layers": layers, "bbox": dict(zip(("minx", "miny", "maxx", "maxy"), b, strict=True))}


def write_json(record: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(record, f, ensure_ascii=False, indent=2)


def sections_json(sections: DataFrame) -> DataFrame:
    """One JSON text per section; fields without a value are written as null."""
    return sections.select("judet", "sv", F.to_json(F.struct(*sections.columns), {"ignoreNullFields": "false"}).alias("json"))


def report(matched: DataFrame) -> DataFrame:
    """All matched addresses of each section with their places in the order of street and number and in that of street and number as text, by the first."""
    of = Window.partitionBy("judet", "sv")
    by = lambda number: [F.asc_nulls_last(c) for c in ("addr_street", number, "addr_id")]
    rows = matched.select("judet", "sv", "addr_street", "addr_housenumber", "addr_housenumber_int", "addr_id", F.row_number().over(of.orderBy(*by("addr_housenumber_int"))).alias("place"), F.row_number().over(of.orderBy(*by("addr_housenumber"))).alias("place_by_text"))
    return rows.orderBy("judet", "sv", "place")
