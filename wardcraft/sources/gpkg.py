"""GeoPackage layers: a Python data source for reading, and a writer that replaces one layer and keeps the others.

A GeoPackage is one SQLite file, so a layer is read by ranges of row ids and written by one task. Rows carry wkb and srid.
"""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from wardcraft.sources.wkb import from_gpkg, load, to_gpkg

_TYPES = {"TEXT": StringType(), "INTEGER": LongType(), "MEDIUMINT": LongType(), "INT": LongType(), "REAL": DoubleType(), "DOUBLE": DoubleType(), "FLOAT": DoubleType(), "BOOLEAN": BooleanType(), "BLOB": BinaryType()}


def _open(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def list_layers(path: str) -> list[tuple[int, str, str, str | None]]:
    """(place, name, geometry type, crs) of each layer, in the file's order."""
    with _open(path) as db:
        rows = db.execute("SELECT c.table_name, g.geometry_type_name, s.organization, s.organization_coordsys_id FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) LEFT JOIN gpkg_spatial_ref_sys s ON g.srs_id = s.srs_id ORDER BY c.rowid").fetchall()
    return [(k, n, t, f"{o}:{i}" if o and o != "NONE" else None) for k, (n, t, o, i) in enumerate(rows)]


class _Part(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class GpkgReader(DataSourceReader):
    def __init__(self, path: str, layer: str, schema: StructType, geometry: str, rows: int):
        self.path, self.layer, self.schema, self.geometry, self.rows = path, layer, schema, geometry, rows

    def partitions(self):
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.layer)}").fetchone()
        return [_Part(a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)] if low is not None else [_Part(0, -1)]

    def read(self, part):
        plain = [c for c in self.schema.names if c not in ("wkb", "srid", "geom_type")]
        columns = ", ".join(_quoted(c) for c in [*plain, self.geometry])
        kinds = {f.name: f.dataType for f in self.schema.fields}
        with _open(self.path) as db:
            for row in db.execute(f"SELECT {columns} FROM {_quoted(self.layer)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (part.low, part.high)):
                values = {c: bool(v) if v is not None and isinstance(kinds[c], BooleanType) else v for c, v in zip(plain, row, strict=False)}
                if row[-1] is not None:
                    values["srid"], values["wkb"] = from_gpkg(row[-1])
                    values["geom_type"] = load(values["wkb"])[0]
                yield tuple(values.get(c) for c in self.schema.names)


class GpkgSource(DataSource):
    """spark.read.format("gpkg").option("layer", name).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _layer(self) -> tuple[str, str]:
        with _open(self.options["path"]) as db:
            found = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns" + (" WHERE table_name = ?" if self.options.get("layer") else ""), [self.options["layer"]] if self.options.get("layer") else []).fetchone()
        if not found:
            raise ValueError(f"no layer {self.options.get('layer')} in {self.options['path']}")
        return found

    def schema(self) -> StructType:
        layer, geometry = self._layer()
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(layer)})").fetchall()
        fields = [StructField(c[1], _TYPES.get(c[2].upper().partition("(")[0], StringType())) for c in columns if c[1] != geometry]
        return StructType([*fields, StructField("geom_type", StringType()), StructField("srid", IntegerType()), StructField("wkb", BinaryType())])

    def reader(self, schema: StructType) -> GpkgReader:
        layer, geometry = self._layer()
        return GpkgReader(self.options["path"], layer, schema, geometry, int(self.options.get("rows", 100_000)))


def read_layer(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A layer; ValueError if it has no rows."""
    spark.dataSource.register(GpkgSource)
    reader = spark.read.format("gpkg")
    df = (reader.option("layer", layer) if layer else reader).load(path)
    if df.isEmpty():
        raise ValueError(f"layer {layer} of {path} is empty")
    return df


def write_layer(df: DataFrame, path: str, layer: str, srid: int = 4326, geometry_type: str = "GEOMETRY") -> None:
    """Write df (with a wkb column) as a layer; a layer of that name is replaced. Rows stream through the driver, as one process has to write a SQLite file."""
    plain = [f for f in df.schema.fields if f.name not in ("wkb", "srid", "geom_type")]
    sql = {LongType: "INTEGER", IntegerType: "INTEGER", DoubleType: "REAL", FloatType: "REAL", BooleanType: "BOOLEAN", BinaryType: "BLOB"}
    db = sqlite3.connect(path)
    try:
        db.execute("PRAGMA application_id = 1196444487")  # fixed value: GPKG in ASCII
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT DEFAULT '', last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', '')", (f"EPSG:{srid}", srid, srid))
        for t in ("gpkg_contents", "gpkg_geometry_columns"):
            db.execute(f"DELETE FROM {t} WHERE table_name = ?", (layer,))
        db.execute(f"DROP TABLE IF EXISTS {_quoted(layer)}")
        db.execute(f"CREATE TABLE {_quoted(layer)} (" + ", ".join([*[f"{_quoted(f.name)} {sql.get(type(f.dataType), 'TEXT')}" for f in plain], "geom BLOB"]) + ")")
        rows = ([r[f.name] for f in plain] + [to_gpkg(bytes(r["wkb"]), srid) if r["wkb"] is not None else None] for r in df.toLocalIterator())
        db.executemany(f"INSERT INTO {_quoted(layer)} VALUES ({', '.join('?' * (len(plain) + 1))})", rows)
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, last_change, srs_id) VALUES (?, 'features', ?, strftime('%Y-%m-%dT%H:%M:%fZ','now'), ?)", (layer, layer, srid))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (layer, geometry_type, srid))
        db.commit()
    finally:
        db.close()
