"""The mini-language of rule cells, as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardcraft.functions.text import num_token, ustrip

#: A number token, a range and a single. The grammar of the rule sheets.
TOKEN = r"[0-9]+(?:\s*[A-Za-z])?(?:\s*BIS)?"
RANGE = rf"(?i)nr\.\s*({TOKEN})\s*-\s*({TOKEN})"
SINGLE = rf"(?i)nr\.\s*({TOKEN})"
EMPTY = r"nr\.\s*-\s*$"

SPEC = "struct<kind:string,parity:string,ranges:array<struct<start:string,end:string>>,singles:array<string>,raw:string>"


def rule_parts(c: Column) -> Column:
    """The trimmed non-blank parts between # signs; null and blank cells have none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "#"), ustrip)
    return F.filter(parts, lambda p: p != "")


def rule_ranges(p: Column) -> Column:
    """The (start, end) pairs of a part."""
    pairs = F.arrays_zip(F.regexp_extract_all(p, F.lit(RANGE), 1).alias("a"), F.regexp_extract_all(p, F.lit(RANGE), 2).alias("b"))
    return F.transform(pairs, lambda x: F.struct(ustrip(x["a"]).alias("start"), ustrip(x["b"]).alias("end")))


def rule_singles(p: Column) -> Column:
    """The single numbers of a part that aren't an end of one of its ranges; repeats stay."""
    found = F.transform(F.regexp_extract_all(p, F.lit(SINGLE), 1), ustrip)
    ends = F.flatten(F.transform(rule_ranges(p), lambda r: F.array(num_token(r["start"]), num_token(r["end"]))))
    return F.filter(found, lambda s: ~F.array_contains(ends, num_token(s)))


def _spec(p: Column) -> Column:
    low = F.lower(p)
    parity = F.when(low.contains("numere impare"), "odd").when(low.contains("numere pare"), "even")
    ranges, singles = rule_ranges(p), rule_singles(p)
    note = (F.size(ranges) == 0) & (F.size(singles) == 0) & parity.isNull()
    whole = low.contains("integral")
    part = lambda c: F.when(~whole, c)
    kind = F.when(whole, "integral").when(note, "note").otherwise("numbers")
    return F.struct(kind.alias("kind"), part(parity).alias("parity"), part(ranges).alias("ranges"), part(singles).alias("singles"), part(p).alias("raw")).cast(SPEC)


def parse_rule_cell(c: Column) -> Column:
    """The specs of a cell in order: kind (integral, numbers or note), parity, ranges, singles, raw."""
    kept = F.filter(rule_parts(c), lambda p: ~F.lower(p).rlike(EMPTY))
    return F.transform(kept, _spec)
