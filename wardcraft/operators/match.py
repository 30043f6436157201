"""Rules against address points, for all sections at once."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcraft.functions.numbers import covers, housenumber_cover, housenumber_int
from wardcraft.functions.patterns import needed
from wardcraft.functions.text import normalize_street
from wardcraft.plans.shared import materialise


def prepare_addresses(addresses: DataFrame) -> DataFrame:
    """With street_norm, cover and, where it isn't there, addr_housenumber_int."""
    out = addresses.withColumn("street_norm", normalize_street(F.col("addr_street"))).withColumn("cover", housenumber_cover(F.col("addr_housenumber")))
    return out if "addr_housenumber_int" in out.columns else out.withColumn("addr_housenumber_int", housenumber_int(F.col("addr_housenumber")))


#: Characters that make a name more than plain text and dots when it is read as a pattern.
_SPECIAL = r"[\\^$|?*+()\[\]{}]"
#: Patterns that need no certain character are tried on the streets in so many shares.
SHARES = 64


def _grams(name: str, size: int | str) -> str:
    """The distinct runs of `size` characters of a name."""
    return f"array_distinct(transform(sequence(1, length({name}) - {size} + 1), i -> substring({name}, i, {size})))"


def _needs(batches):
    """Names read as patterns -> (rule_norm, gram), a row for each of the runs of which a street must have one; none for what is no pattern."""
    for batch in batches:
        rows = [(x, g) for x in batch.column("rule_norm").to_pylist() for g in sorted(needed(x) or ())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["rule_norm", "gram"])


def _searched(batches):
    """Pairs (rule_norm, street_norm) where the name, as a pattern, is found in the street."""
    compiled = lru_cache(10_000)(re.compile)
    for batch in batches:
        names, streets = (batch.column(c).to_pylist() for c in ("rule_norm", "street_norm"))
        yield batch.filter(pa.array([compiled(n).search(x) is not None for n, x in zip(names, streets, strict=True)], pa.bool_()))


def street_links(norms: DataFrame, streets: DataFrame) -> DataFrame:
    """norms(rule_norm), streets(street_norm), both distinct -> (rule_norm, street_norm).

    Equal names; for a rule name that equals none and isn't empty, the names in which it is found as a regular expression. Plain
    names (and those whose only sign is a dot) meet the streets that have their rarest run of up to three characters. Names that are real
    patterns meet the streets that have one of the runs which the pattern needs (`needed`); only one that needs none, and so
    is found nearly everywhere, is tried on all streets, in shares. One that is no valid pattern finds nothing.
    """
    equal = norms.join(streets, norms.rule_norm == streets.street_norm).select("rule_norm", "street_norm")
    left = norms.where("rule_norm <> ''").join(streets, norms.rule_norm == streets.street_norm, "left_anti")
    bare = F.expr("array_max(transform(split(rule_norm, '[.]'), x -> struct(length(x) as n, x as x)))")
    plain = left.where(~F.col("rule_norm").rlike(_SPECIAL)).withColumn("part", bare).where("part.n > 0")
    wanted = plain.select("rule_norm", F.explode(F.expr(_grams("part.x", "least(3, part.n)"))).alias("gram"))
    odd = norms.where(F.col("rule_norm").rlike(_SPECIAL) | F.col("rule_norm").rlike(r"^[.]+\z"))
    odd = odd.join(streets, odd.rule_norm == streets.street_norm, "left_anti").select("rule_norm").mapInArrow(_needs, "rule_norm string, gram string")
    held = streets.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("length(street_norm) >= n").select("street_norm", F.explode(F.expr(_grams("street_norm", "n"))).alias("gram"))
    held = held.join(wanted.select("gram").union(odd.select("gram")).distinct(), "gram", "left_semi")
    common = held.groupBy("gram").count()
    rarest = wanted.join(common, "gram", "left").groupBy("rule_norm").agg(F.min_by("gram", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "gram")).alias("gram"))
    found = rarest.join(held, "gram").where(F.when(F.col("rule_norm").contains("."), F.expr("street_norm rlike rule_norm")).otherwise(F.col("street_norm").contains(F.col("rule_norm"))))
    some = odd.where("gram <> ''").join(held, "gram").select("rule_norm", "street_norm").distinct()
    shares = odd.where("gram = ''").select("rule_norm", F.explode(F.expr(f"sequence(0, {SHARES - 1})")).alias("share"))
    every = shares.join(streets.withColumn("share", F.expr(f"cast(pmod(xxhash64(street_norm), {SHARES}) as int)")), "share").select("rule_norm", "street_norm")
    searched = some.unionByName(every).mapInArrow(_searched, "rule_norm string, street_norm string")
    return equal.unionByName(found.select("rule_norm", "street_norm")).unionByName(searched)


_TEST = ("rule_norm", "kind", "parity", "ranges", "singles")
#: So many rows of a kind stand in one array, about.
LOT = 1024
#: The rules of a street with more than MANY are dealt out in PARTS shares, and so are its addresses: each share of the one meets each of the other.
MANY, PARTS = 1024, 6


def _lots(rows: DataFrame, by: list[str], into: str) -> DataFrame:
    """One row per kind (what is equal in `by`), with its other columns as the array `into`; a kind of many rows has several, told apart by lot."""
    rest = [c for c in rows.columns if c not in by] or ["_n"]
    rows = rows.withColumns({"_kind": F.xxhash64(*by), "_n": F.monotonically_increasing_id()})
    many = rows.groupBy("_kind").agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > LOT)
    dealt = rows.join(many, "_kind", "left").withColumn("lot", F.expr(f"pmod(xxhash64(_n), coalesce(_many div {LOT} + 1, 1))"))
    return dealt.groupBy(*by, "lot").agg(F.collect_list(F.struct(*rest)).alias(into))


def match_rows(specs: DataFrame, addresses: DataFrame, keys: tuple[str, ...] = (), columns: tuple[str, ...] | None = None) -> DataFrame:
    """Every (spec, address) that matches. specs: as of flat_specs; addresses: as of prepare_addresses.

    keys: columns that both tables have and that have to be equal as well (a locality, so that the main streets of all towns don't meet); a null there meets nothing.
    columns: those of the result; all of both tables, unless they are named.
    The result may have as many rows as the square of the tables, so it is made last and never shuffled. What is shuffled and written grows as the
    tables do: a row per test and per cover, with the specs that ask for it and the addresses that have it as arrays. These meet by street, are
    tested once, and are laid out then: addresses within a spec, so that a file of the result repeats itself and is small.
    Streets with many rows are dealt out, and all meet by sorting: a few names can stand for all rows, so that neither table is sent to the tasks of the other.
    """
    spark = specs.sparkSession
    wanted = specs.where("kind in ('integral', 'numbers') and street <> ''").withColumnRenamed("street_norm", "rule_norm").withColumnRenamed("row_id", "rule_no")
    columns = tuple(columns or (*wanted.columns, *[c for c in addresses.columns if c not in keys]))
    if twice := sorted(set(wanted.columns) & set(addresses.columns) & set(columns) - set(keys)):
        raise ValueError(f"both tables have {twice}: rename them, or name the columns of the result without them")
    asked, street = [*keys, *_TEST], [*keys, "street_norm"]
    had = [*street, "cover"]
    wanted = materialise(spark, wanted.select(*asked, *[c for c in wanted.columns if c in columns and c not in asked]), "wanted")
    addresses = materialise(spark, addresses.select(*had, *[c for c in addresses.columns if c in columns and c not in had]), "addresses")
    links = materialise(spark, street_links(wanted.select("rule_norm").distinct(), addresses.select("street_norm").distinct()), "links")
    rules = materialise(spark, _lots(wanted, asked, "rules"), "rules").join(links.hint("merge"), "rule_norm")
    places = materialise(spark, _lots(addresses, had, "places"), "places")
    shares = lambda rows, c: rows.groupBy(*street).agg(F.expr(f"if(sum(size({c})) > {MANY}, {PARTS}, 1)").alias(f"{c}_in"))
    dealt = materialise(spark, shares(rules, "rules").join(shares(places, "places"), street), "dealt").hint("merge")
    share = lambda c, *of: F.expr(f"cast(pmod(xxhash64({', '.join(of)}, lot), {c}_in) as int)").alias(f"{c}_at")
    every = lambda c: F.explode(F.expr(f"sequence(0, {c}_in - 1)")).alias(f"{c}_at")
    rules = rules.join(dealt, street).select(*street, *_TEST, "rules", share("rules", *_TEST), every("places"))
    places = places.join(dealt, street).select(*had, "places", share("places", "cover"), every("rules"))
    few, block = int(spark.conf.get("spark.sql.shuffle.partitions", "200")), [*street, "rules_at", "places_at"]  # a count, as arrays are few rows for what they are laid out to
    rules, places = rules.repartition(few, *block).alias("w"), places.repartition(few, *block).alias("p")
    good = (F.col("kind") == "integral") | covers(F.col("cover"), F.col("parity"), F.col("ranges"), F.col("singles"))
    met = rules.hint("merge").join(places, [F.col(f"w.{c}") == F.col(f"p.{c}") for c in block] + [good])
    asks, kept = [c for c in wanted.columns if c in columns and c not in asked], [c for c in dict.fromkeys([*asked, *had]) if c in columns]
    met = met.select(*[F.col(f"w.{c}").alias(c) if c in street else c for c in kept], "places", F.inline("rules"))
    return met.select(*kept, *asks, F.inline("places")).select(*columns)


def source_preference(c: Column) -> Column:
    """way before relation before node before anything else."""
    return F.when(c.startswith("way:"), 0).when(c.startswith("relation:"), 1).when(c.startswith("node:"), 2).otherwise(3)


def dedupe_by_address(rows: DataFrame, keys: tuple[str, ...] = (), street: str = "street_norm", number: str = "addr_housenumber_int", id_col: str | None = "addr_id", order: tuple[str, ...] = ()) -> DataFrame:
    """One row per (keys, street, number): the preferred source, then the smallest id; without ids the first by `order`.

    A missing number is one key like any other. The choice is a minimum, so each task sends one row per key.
    """
    if number not in rows.columns:
        rows = rows.withColumn(number, housenumber_int(F.col("addr_housenumber")))
    by = F.struct(F.coalesce(source_preference(F.col(id_col)), F.lit(3)), F.col(id_col).isNull(), F.col(id_col)) if id_col else F.struct(*order)
    best = rows.groupBy(*keys, street, number).agg(F.min_by(F.struct(*rows.columns), by).alias("r"))
    return best.select("r.*")


def match_addresses(specs: DataFrame, addresses: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The addresses of every section, one row per street and number in each.

    Of addresses that no spec can tell apart (of one street, cover and number) only the preferred one meets the specs.
    """
    ready = prepare_addresses(addresses)
    ready = dedupe_by_address(ready, (*keys, "cover"))
    found = match_rows(specs, ready, keys, ("judet", "sv", *addresses.columns, *[c for c in ("street_norm", "addr_housenumber_int") if c not in addresses.columns]))
    return dedupe_by_address(found, ("judet", "sv", *[k for k in keys if k not in ("judet", "sv")]))
