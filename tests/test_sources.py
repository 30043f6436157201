import json
import zipfile

import pytest
from pyspark.sql import functions as F

from wardcraft.operators import assets, sections
from wardcraft.operators.match import match_rows
from wardcraft.sources import gpkg, osm, sinks, wkb, xlsx
from wardcraft.streaming import addresses as stream

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _xlsx(path, header, body):
    names = "".join(f'<c r="{chr(65 + k)}1" t="s"><v>{k}</v></c>' for k in range(len(header)))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="Foaie" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><r><t>{h[:2]}</t></r><r><t>{h[2:]}</t></r></si>" for h in header) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {MAIN}><sheetData><row r="1">{names}</row>{body}</sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    header = [*sections.COLUMNS]
    header[0] = " JUDET "
    body = '<row r="2"><c r="A2" t="inlineStr"><is><t>B</t></is></c><c r="C2"><v>1</v></c></row><row r="4"><c r="A4" t="str"><v>B</v></c><c r="I4" t="inlineStr"><is><t>Str. A</t></is></c><c r="J4" t="inlineStr"><is><t>integral#</t></is></c></row>'
    _xlsx(path, header, body)
    for sheet in (0, "Foaie"):
        df = xlsx.load_rsv_xlsx(spark, path, sheet)
        assert [(r.row_id, r.judet, r.nr_sv, r.artera) for r in df.orderBy("row_id").collect()] == [(0, "B", "1", None), (1, "B", None, "Str. A")]
    assert sections.parse_section(df, "B", 1).first().rules[0].specs[0].kind == "integral"
    _xlsx(path, header[1:], "")
    with pytest.raises(ValueError, match="JUDET"):
        xlsx.load_rsv_xlsx(spark, path)
    with pytest.raises(Exception):
        xlsx.load_rsv_xlsx(spark, str(tmp_path / "none.xlsx"))


def test_gpkg(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    rows = [("way:1", 3, bytearray(wkb.dump("Point", (1.0, 2.0)))), ("x", None, bytearray(wkb.dump("Polygon", [[(0, 0), (1, 0), (1, 1), (0, 0)]]))), ("n", 5, None)]
    df = spark.createDataFrame(rows, "addr_id string, n bigint, wkb binary")
    gpkg.write_layer(df, path, "addresses", 3844)
    gpkg.write_layer(df.limit(1), path, "other", 4326, "POINT")
    gpkg.write_layer(df, path, "addresses", 3844)
    assert [(x[1], x[3]) for x in gpkg.list_layers(path)] == [("other", "EPSG:4326"), ("addresses", "EPSG:3844")]
    got = {r.addr_id: (r.n, r.geom_type, r.srid, r.wkb) for r in gpkg.read_layer(spark, path, "addresses").collect()}
    assert got["way:1"] == (3, "Point", 3844, rows[0][2]) and got["x"][1] == "Polygon" and got["n"] == (5, None, None, None)
    with pytest.raises(Exception):
        gpkg.read_layer(spark, path, "none")
    for kind, c in (("LineString", [(0.0, 1.0), (2.0, 3.0)]), ("MultiPolygon", [[[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]]])):
        assert wkb.load(wkb.dump(kind, c))[:2] == (kind, c)


def _path(*points):
    return [{"lat": float(y), "lon": float(x)} for x, y in points]


def test_street_lookup_and_numbers(spark):
    streets = spark.createDataFrame([("Bd. Ion (X)",), ("Str. Ion Mic",), (None,)], "name string")
    assert assets.street_named(streets, "bd. ION").count() == 1 and assets.street_named(streets, "Ion").count() == 2
    assert assets.street_named(streets, "i.n m").count() == 1 and assets.street_named(streets, "^str|^bd").count() == 2
    with pytest.raises(ValueError):
        assets.street_named(streets, "ion [")
    with pytest.raises(ValueError, match="Bd. Ion"):
        assets.street_named(streets, "Ana")
    rows = spark.createDataFrame([(f"k{k:04d}",) for k in range(500)], "a string").repartition(7)
    assert [(r.a, r.n) for r in assets.with_surrogate_id(rows, "n", "a").orderBy("n").collect()] == [(f"k{k:04d}", k) for k in range(500)]
    assert assets.with_surrogate_id(rows.limit(0), "n", "a").count() == 0


def test_extract_layers_and_sinks(spark, tmp_path):
    ring = [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 2.0}, {"lat": 2.0, "lon": 2.0}, {"lat": 0.0, "lon": 0.0}]
    elements = [
        {"type": "node", "id": 1, "lat": 44.0, "lon": 26.0, "tags": {"addr:housenumber": "A12", "addr:street": "S"}},
        {"type": "way", "id": 2, "nodes": [1, 3, 4, 1], "geometry": ring, "tags": {"building": "yes", "addr:housenumber": "7"}},
        {"type": "way", "id": 5, "nodes": [1, 3, 4], "geometry": ring[:3], "tags": {"highway": "primary", "name": "S"}},
        {"type": "node", "id": 9, "lat": 1.0, "lon": 1.0, "tags": None},
        {"type": "relation", "id": 6, "members": [{"type": "way", "ref": 1, "role": "outer", "geometry": _path((0, 0), (9, 0), (9, 9))}, {"type": "way", "ref": 2, "role": "outer", "geometry": _path((0, 0), (0, 9), (9, 9))}, {"type": "way", "ref": 3, "role": "inner", "geometry": _path((2, 2), (7, 2), (7, 7), (2, 7), (2, 2))}], "tags": {"building": "yes", "addr:housenumber": "9"}},
    ]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, elements)))
    e = osm.read_elements(spark, str(tmp_path / "e.json"))
    a = assets.addresses_layer(osm.tagged_features(e, "addr:housenumber"))
    assert {(r.addr_id, r.addr_housenumber_int, r.source) for r in a.collect()} == {("node:1", 12, "node"), ("way:2", 7, "building"), ("relation:6", 9, "building")}
    inner = {r.addr_id: (r.x, r.y) for r in a.collect()}
    assert inner["relation:6"][1] == 4.5 and (0 < inner["relation:6"][0] < 2 or 7 < inner["relation:6"][0] < 9) and 0 < inner["way:2"][1] < inner["way:2"][0] < 2
    edges = osm.street_edges(e)
    length = pytest.approx(222_390.2, abs=1)
    assert [(r.u, r.v, r.key, r.osmid, r.length_m) for r in assets.streets_layer(edges).orderBy("u", "v").collect()] == [(u, v, 0, "5", length) for u, v in ((1, 3), (3, 1), (3, 4), (4, 3))]
    assert {(r.osmid, r.street_count) for r in assets.nodes_layer(osm.street_nodes(edges)).collect()} == {(1, 1), (3, 2), (4, 1)}
    b = assets.buildings_layer(osm.tagged_features(e, "building"))
    assert sorted((r.osm_id, r.addr_housenumber, wkb.load(bytes(r.wkb))[0]) for r in b.collect()) == [("relation:6", "9", "MultiPolygon"), ("way:2", "7", "Polygon")]
    sinks.write_layer(a, str(tmp_path / "layers"), "addresses")
    sinks.write_layer(a, str(tmp_path / "layers"), "addresses")
    assert sinks.read_layer(spark, str(tmp_path / "layers"), "addresses").count() == 3
    m = sinks.metadata(a, "X", "X, Y", 3844, ["addresses"], {"network_type": "drive", "simplify": True, "retain_all": False}, "layers")
    sinks.write_json(m, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())["bbox"] == m["bbox"]
    with pytest.raises(ValueError):
        assets.first_available(a, ("none",))
    assert assets.boundary_layer(spark.createDataFrame([(0.0, 1.0, 2.0, 3.0)], "x0 double, y0 double, x1 double, y1 double"), "X").first().x1 == 2.0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("way:1", "Str. A", "7"), ("way:2", "Str. B", "8")], "addr_id string, addr_street string, addr_housenumber string")
    rows.write.parquet(str(tmp_path / "in"))
    spec = spark.createDataFrame([("B", 1, 0, 0, "Str. A", "str. a", "integral", None, None, None)], "judet string, sv bigint, row_id bigint, spec_no int, street string, street_norm string, kind string, parity string, ranges array<struct<start:string,end:string>>, singles array<string>")
    s = stream.read_stream(spark, str(tmp_path / "in"), "addr_id string, addr_street string, addr_housenumber string")
    assert stream.prepared(s).isStreaming
    stream.match_batches(spec, s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.addr_id for r in stream.matched(spark, str(tmp_path / "out")).collect()] == ["way:1"]
    assert match_rows(spec, stream.prepare_addresses(rows)).count() == 1


def test_stream_does_not_depend_on_batches(spark, tmp_path):
    """The name equals a street of the last file only, so the fallbacks of the others don't hold."""
    schema = "addr_id string, addr_street string, addr_housenumber string"
    for k, name in enumerate(["Bd. Mihai", "Strada Mihai Mic", "Mihai", "Str. Ana Mare"]):
        spark.createDataFrame([(f"way:{k}", name, "7"), (f"way:x{k}", "Alta", "1")], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    spec = spark.createDataFrame([("B", 1, k, 0, s, s, "integral", None, None, None) for k, s in enumerate(["mihai", "ana"])], "judet string, sv bigint, row_id bigint, spec_no int, street string, street_norm string, kind string, parity string, ranges array<struct<start:string,end:string>>, singles array<string>")
    s = stream.read_stream(spark, str(tmp_path / "in/*"), schema, files=1)
    stream.match_batches(spec, s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = stream.matched(spark, str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 1 or got.count() == 2
    assert sorted(r.addr_id for r in got.collect()) == ["way:2", "way:3"]
    again = match_rows(spec, stream.prepare_addresses(spark.read.schema(schema).parquet(str(tmp_path / "in/*"))))
    assert sorted(r.addr_id for r in again.collect()) == ["way:2", "way:3"]
