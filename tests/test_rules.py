import pytest
from pyspark.sql import functions as F

from wardcraft.functions.numbers import covers, housenumber_cover, housenumber_int
from wardcraft.functions.rules import parse_rule_cell
from wardcraft.functions.text import normalize_street, normalize_street_exact, slug, weak_norm
from wardcraft.operators import sections
from wardcraft.operators.match import dedupe_by_address, match_addresses

CELLS = {
    None: [],
    "  ": [],
    "nr. -#": [],
    "numere impare nr. -#": [],
    "integral#": [("integral", None, None, None)],
    "numere impare nr. 75 -109#": [("numbers", "odd", [("75", "109")], [])],
    "numere impare nr. 111 -119# numere pare nr. 64 -72#": [("numbers", "odd", [("111", "119")], []), ("numbers", "even", [("64", "72")], [])],
    "numere impare nr. 21 -299 BIS# nr. 301 -319# nr. 319 B#": [("numbers", "odd", [("21", "299 B")], []), ("numbers", None, [("301", "319")], []), ("numbers", None, [], ["319 B"])],
    "numere impare#": [("numbers", "odd", [], [])],
    "bloc A#": [("note", None, [], [])],
    "nr. 5, nr. 7#": [("numbers", None, [], ["5", "7"])],
    "nr. 5 nr. 7#": [("numbers", None, [], ["5 n"])],
    "nr. 21 -299 nr. 301#": [("numbers", None, [("21", "299 n")], ["301"])],
    "nr. 75 – 109#": [("numbers", None, [], ["75"])],
    "numere pare nr. 2 BIS -10#": [("numbers", "even", [("2 BIS", "10")], ["2 B"])],
    "NR. 7A#": [("numbers", None, [], ["7A"])],
    "Integral #nr. 3#": [("integral", None, None, None), ("numbers", None, [], ["3"])],
}
NUMBERS = {"14": (14, 14, 1, None, False, 14), " 14 ": (14, 14, 1, None, False, 14), "75-79": (75, 79, 2, "odd", True, 75), "79-75": (75, 79, 2, "odd", True, 79), "64-72": (64, 72, 2, "even", True, 64), "75–78": (75, 78, 1, None, True, 75), "7-7": (7, 7, 2, "odd", True, 7), "109A": (109, 109, 1, None, False, 109), "109A-113": (109, 109, 1, None, False, 109), "14, 16": (14, 14, 1, None, False, 14), "14-16-18": (14, 14, 1, None, False, 14), "A12": (None, None, None, None, False, 12), "bis": (None, None, None, None, False, None), "": (None, None, None, None, False, None), None: (None, None, None, None, False, None)}
COVERS = [
    ("odd", [("75", "109")], [], ["75", "75-79", "109-112"], ["76", "76-80", "108-112", "110-113", "A12", None]),
    ("odd", [("76", "80")], [], ["73-76", "76-77"], ["75", "76"]),
    (None, [("301", "319")], [], ["301", "300-302"], ["300", "320"]),
    (None, [("8", "2")], [], ["2", "8"], ["9"]),
    ("odd", [("21", "299 B")], [], [], ["21", "23", "75"]),
    (None, [], ["319 B"], ["1", "2-4"], ["A12", None]),
    ("odd", [], [], ["3", "3-4"], ["4", "4-6"]),
    (None, [("1", "9")], ["20"], ["6-20"], ["5", "20", "5-21"]),
]


def test_rule_cells(spark):
    rows = spark.createDataFrame([(k,) for k in CELLS], "c string").select("c", parse_rule_cell(F.col("c")).alias("s")).collect()
    for r in rows:
        got = [(x.kind, x.parity, None if x.ranges is None else [tuple(y) for y in x.ranges], x.singles) for x in r.s]
        assert got == CELLS[r.c], r.c


def test_house_numbers(spark):
    rows = spark.createDataFrame([(k,) for k in NUMBERS], "c string").select("c", housenumber_cover(F.col("c")).alias("s"), housenumber_int(F.col("c")).alias("n")).collect()
    for r in rows:
        assert (*r.s, r.n) == NUMBERS[r.c], r.c


@pytest.mark.parametrize("parity,ranges,singles,yes,no", COVERS)
def test_covers(spark, parity, ranges, singles, yes, no):
    df = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no], "hn string, want boolean")
    r = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ranges]).cast("array<struct<start:string,end:string>>")
    s = F.array(*[F.lit(x) for x in singles]).cast("array<string>")
    assert df.where(covers(housenumber_cover(F.col("hn")), F.lit(parity).cast("string"), r, s) != F.col("want")).collect() == []


def test_cover_overlap_against_listing(spark):
    cases = [(lo, hi, a, b) for lo in range(0, 9) for hi in range(lo, 10) for a in range(0, 10, 3) for b in range(0, 10, 2)]
    df = spark.createDataFrame([(f"{lo}-{hi}", str(a), str(b)) for lo, hi, a, b in cases], "hn string, a string, b string")
    ranges = F.array(F.struct(F.col("a").alias("start"), F.col("b").alias("end")))
    got = df.select(covers(housenumber_cover(F.col("hn")), F.lit(None).cast("string"), ranges, F.array().cast("array<string>")).alias("x")).collect()
    for (lo, hi, a, b), r in zip(cases, got, strict=True):
        numbers = range(lo, hi + 1, 2 if lo % 2 == hi % 2 else 1)
        assert r.x == any(min(a, b) <= n <= max(a, b) for n in numbers), (lo, hi, a, b)


def test_street_names(spark):
    want = {"Șoseaua Ștefan cel Mare (fost X)": "soseaua stefan cel mare", "Str. (a) b (c)": "str. b", "(x)": "", None: "", "Str. Łódź": "str. łodz", " A  B ": "a b"}
    df = spark.createDataFrame([(k,) for k in want], "c string").select("c", normalize_street(F.col("c")).alias("n"), normalize_street_exact(F.col("c")).alias("e")).collect()
    assert all(r.n == r.e == want[r.c] for r in df)
    r = spark.createDataFrame([(" Șos. X ",)], "c string").select(weak_norm(F.col("c")).alias("w"), slug(F.col("c")).alias("s")).first()
    assert (r.w, r.s) == ("șos. x", "os_x")


def _sheet(spark, rows):
    names = ("row_id", "judet", "nr_sv", "artera", "numar_imobil")
    full = [(*r, None, None, None, None, None, None) for r in rows]
    return spark.createDataFrame(full, ", ".join(f"{n} {'bigint' if n == 'row_id' else 'string'}" for n in names) + ", uat string, sediu_sv string, adresa_sv string, adresa_sv_descriptiva string, localitate_sat string, cod_artera string")


def test_fill_headers_notes(spark):
    sheet = _sheet(spark, [(0, "B", "1", None, "nr. -#"), (1, "CJ", "50", None, None), (2, " B ", None, "Str. A", "integral#"), (3, "B", "2", None, None), (4, "B", None, "Domiciliul pe raza", "x"), (5, "B", "2.5", "Str. C", "integral#"), (6, "B", "nan", "Str. D", None)])
    blocks = sections.segment_blocks(sheet)
    assert {r.row_id: r.sv for r in blocks.collect()} == {0: 1, 1: 50, 2: 1, 3: 2, 4: 2, 5: None, 6: None}
    assert [(r.sv, r.raw) for r in sections.section_notes(blocks).collect()] == [(2, "x")]
    assert [(r.sv, r.raw) for r in sections.section_notes(blocks, previous_text=True).collect()] == [(2, None)]
    one = sections.parse_section(sheet, "B", 1).first()
    assert one.rules[0].street == "Str. A" and one.rules[0].specs[0].kind == "integral"
    with pytest.raises(ValueError):
        sections.parse_section(sheet, "B", 9)
    assert sections.parse_sections(sheet.limit(0)).count() == 0


def test_match_prefers_equal_names_and_dedupes(spark):
    addresses = spark.createDataFrame([(1, "node:1", "Bulevardul Ion Mihalache", "75"), (2, "way:9", "Str. A", "75"), (3, "way:10", "str. a", "75A"), (4, "node:1", "STR. A", "75-79"), (5, "x", None, "3"), (6, "way:1", "Str. A", "A")], "row_id bigint, addr_id string, addr_street string, addr_housenumber string")
    rules = _sheet(spark, [(0, "B", "1", None, None), (1, "B", None, "Ion Mihalache", "numere impare#"), (2, "B", None, "Str. A (x)", "integral#"), (3, "B", None, "(gone)", "integral#"), (4, "B", None, "Nowhere", "integral#")])
    specs = sections.flat_specs(sections.section_rules(sections.segment_blocks(rules)))
    got = {(r.street_norm, r.addr_housenumber_int): r.addr_id for r in match_addresses(specs, addresses).collect()}
    assert got == {("bulevardul ion mihalache", 75): "node:1", ("str. a", 75): "way:10", ("str. a", None): "way:1", ("", 3): "x"}
    assert dedupe_by_address(match_addresses(specs, addresses), ("judet",), id_col=None, order=("row_id",)).count() == 4
