"""From a rule sheet to the rules of every section: fill, header rows, rules, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wardcraft.functions.rules import parse_rule_cell
from wardcraft.functions.text import normalize_street, safe_int, safe_str, to_number, ustrip
from wardcraft.operators.fill import filled

#: Columns of the official sheet and their names here. Fixed values.
COLUMNS = {"JUDET": "judet", "UAT": "uat", "Nr SV": "nr_sv", "Sediu SV": "sediu_sv", "Adresa SV": "adresa_sv", "Adresa SV descriptivă": "adresa_sv_descriptiva", "Localitate componentă/ Sat aparținător": "localitate_sat", "Cod Arteră": "cod_artera", "Arteră": "artera", "Număr imobil / Alfabetic": "numar_imobil"}


def normalise_header(sheet: DataFrame) -> DataFrame:
    """Trimmed column names; ValueError names the required ones that are missing."""
    out = sheet.toDF(*[c.strip() for c in sheet.columns])
    if missing := [c for c in COLUMNS if c not in out.columns]:
        raise ValueError(f"missing columns: {missing}")
    return out.withColumnsRenamed(COLUMNS)


def segment_blocks(rows: DataFrame) -> DataFrame:
    """rows(row_id, judet, nr_sv, ...) -> with judet trimmed, sv filled down in each county, explicit.

    The fill is a scan over sorted ranges (`fill.filled`), so a county may hold any part of the sheet. A number that isn't whole ends the block
    before it, and its own rows have no section.
    """
    out = rows.withColumn("judet", ustrip(F.col("judet"))).withColumn("_n", to_number(F.col("nr_sv")))
    out = filled(out, "judet", "row_id", "_n", "_f")
    whole = F.when(F.col("_f") == F.floor("_f"), F.col("_f").cast("bigint"))
    return out.withColumn("sv", whole).withColumn("explicit", F.col("_n").eqNullSafe(F.col("_f"))).drop("_n", "_f")


def headers(blocks: DataFrame) -> DataFrame:
    """The header of each section: its first row with the number written out, else its first row."""
    fields = ("uat", "sediu_sv", "adresa_sv", "adresa_sv_descriptiva", "localitate_sat")
    row = F.struct("row_id", *[safe_str(F.col(c)).alias(c) for c in fields])
    first = blocks.where("sv is not null").groupBy("judet", "sv").agg(F.min_by(row, F.struct((~F.col("explicit")).cast("int"), "row_id")).alias("h"))
    return first.select("judet", "sv", "h.*")


def rule_rows(blocks: DataFrame) -> DataFrame:
    """Rows with a street, with is_note for the ones that are remarks about residence."""
    rows = blocks.where("sv is not null").withColumn("street", safe_str(F.col("artera"))).where("street is not null")
    raw = safe_str(F.col("numar_imobil"))
    return rows.select("judet", "sv", "row_id", safe_int(F.col("cod_artera")).alias("cod_artera"), "street", raw.alias("raw"), F.lower("street").startswith("domiciliul").alias("is_note"))


def section_rules(blocks: DataFrame) -> DataFrame:
    """judet, sv, row_id, cod_artera, street, raw, specs: one row per rule."""
    return rule_rows(blocks).where("not is_note").drop("is_note").withColumn("specs", parse_rule_cell(F.col("raw")))


def section_notes(blocks: DataFrame, previous_text: bool = False) -> DataFrame:
    """judet, sv, row_id, street, raw of remarks. previous_text: raw is the text of the section's last rule before, as a known fault of older tools had it."""
    rows = rule_rows(blocks)
    if previous_text:
        before = Window.partitionBy("judet", "sv").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("raw", F.last(F.when(~F.col("is_note"), F.struct("raw")), ignorenulls=True).over(before)["raw"])
    return rows.where("is_note").select("judet", "sv", "row_id", "street", "raw")


def flat_specs(rules: DataFrame) -> DataFrame:
    """One row per spec: judet, sv, row_id, spec_no, street, street_norm, kind, parity, ranges, singles."""
    out = rules.select("judet", "sv", "row_id", "street", normalize_street(F.col("street")).alias("street_norm"), F.posexplode("specs").alias("spec_no", "s"))
    return out.select("judet", "sv", "row_id", "spec_no", "street", "street_norm", "s.kind", "s.parity", "s.ranges", "s.singles")


def parse_sections(sheet: DataFrame, source: str | None = None, sheet_name: str = "0") -> DataFrame:
    """The nested record of every section: judet, sv, uat, polling_place, rules, notes, source."""
    blocks = segment_blocks(sheet)
    keys = ["judet", "sv"]
    ordered = lambda item: F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])
    rules = section_rules(blocks).groupBy(keys).agg(ordered(F.struct("row_id", F.struct("cod_artera", "street", "raw", "specs").alias("v"))).alias("rules"))
    notes = section_notes(blocks).groupBy(keys).agg(ordered(F.struct("row_id", F.struct("street", "raw").alias("v"))).alias("notes"))
    head = headers(blocks).select(*keys, "uat", F.struct("sediu_sv", "adresa_sv", "adresa_sv_descriptiva", "localitate_sat").alias("polling_place"))
    none = F.array().cast("array<struct<cod_artera:bigint,street:string,raw:string,specs:array<struct<kind:string,parity:string,ranges:array<struct<start:string,end:string>>,singles:array<string>,raw:string>>>>")
    out = head.join(rules, keys, "left").join(notes, keys, "left")
    return out.withColumn("rules", F.coalesce("rules", none)).withColumn("source", F.struct(F.lit(source).cast("string").alias("xlsx_path"), F.lit(sheet_name).alias("sheet_name")))


def parse_section(sheet: DataFrame, judet: str = "B", sv: int = 1, source: str | None = None) -> DataFrame:
    """One section; ValueError if the sheet hasn't it."""
    out = parse_sections(sheet.where(ustrip(F.col("judet")) == judet), source).where(F.col("sv") == sv)
    if out.isEmpty():
        raise ValueError(f"section {sv} of {judet} not found")
    return out
