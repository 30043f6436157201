import random
import re

import pytest
from pyspark.sql import functions as F

from wardcraft.operators import match

SPEC = "judet string, sv bigint, row_id bigint, spec_no int, street string, street_norm string, kind string, parity string, ranges array<struct<start:string,end:string>>, singles array<string>"


def test_links_against_plain_patterns(spark):
    r = random.Random(3)
    streets = sorted({"".join(r.choice("ab. cd(") for _ in range(r.randint(0, 9))) for _ in range(300)} | {"str. mihai", "strada mihai", "x"})
    names = sorted({"".join(r.choice("ab. c") for _ in range(r.randint(0, 4))) for _ in range(80)} | {"mihai", "str. mihai", "a(", "[", "a|b", "^str", ".", "..", "(a)+", "x{", "*", "\\", "mihai$", "a)", "\U0001f600", "(?i)AB", "a+b", "[ab]c", "b?", "(ab|cd)", ".*", "[^a]", "(a{2})", "\\d", "x*a", "(?=b)b", "[a-d]d"})
    got = {(x.rule_norm, x.street_norm) for x in match.street_links(spark.createDataFrame([(n,) for n in names], "rule_norm string"), spark.createDataFrame([(s,) for s in streets], "street_norm string")).collect()}
    want = set()
    for n in names:
        if n in streets:
            want.add((n, n))
        elif n:
            try:
                want |= {(n, s) for s in streets if re.search(n, s)}
            except re.error:
                pass
    assert got == want and len(got) > 1000


def _rows(spark, keys):
    r = random.Random(5)
    specs, addresses = [], []
    for k in range(60):
        ranges = [(str(r.randint(1, 9)), str(r.randint(5, 30)))] if r.random() < 0.5 else None
        specs.append(("B", k % 3, k, 0, "x", r.choice(["str. a", "str. b", "mihai", "a("]), r.choice(["integral", "numbers", "numbers"]), r.choice(["odd", "even", None]), ranges, r.choice([None, ["3"], ["4", "7 A"]]), r.choice(["p", "q"])))
    for k in range(200):
        addresses.append((r.choice([f"way:{k}", f"node:{k}", None]), r.choice(["Str. A", "Str. B", "Bd. Mihai", "a(", None]), r.choice([str(r.randint(1, 30)), "3-9", "2-5", None, "x"]), r.choice(["p", "q"])))
    return spark.createDataFrame(specs, SPEC + ", town string"), match.prepare_addresses(spark.createDataFrame(addresses, "addr_id string, addr_street string, addr_housenumber string, town string"))


@pytest.mark.parametrize("keys", [(), ("town",)])
def test_rows_against_a_plain_join(spark, keys):
    specs, addresses = _rows(spark, keys)
    specs, addresses = (specs, addresses) if keys else (specs.drop("town"), addresses)
    w = specs.withColumnRenamed("street_norm", "rule_norm").withColumnRenamed("row_id", "rule_no")
    links = match.street_links(w.select("rule_norm").distinct(), addresses.select("street_norm").distinct())
    good = (F.col("kind") == "integral") | match.covers(F.col("cover"), F.col("parity"), F.col("ranges"), F.col("singles"))
    plain = w.join(links, "rule_norm").join(addresses, [*keys, "street_norm"]).where(good)
    key = lambda df: sorted(str((x.rule_no, x.addr_id, x.street_norm, x.addr_housenumber)) for x in df.select("rule_no", "addr_id", "street_norm", "addr_housenumber").collect())
    got = match.match_rows(specs, addresses, keys)
    assert key(got) == key(plain) and len(key(got)) > 500
    best = match.match_addresses(specs, addresses.drop("street_norm", "cover"), keys)
    same = match.dedupe_by_address(plain.drop("town") if not keys else plain, ("judet", "sv", *keys))
    pick = lambda df: sorted(str((x.sv, x.street_norm, x.addr_housenumber_int, x.addr_id)) for x in df.collect())
    assert pick(best) == pick(same)


def test_a_few_names_dont_stand_for_all_rows(spark, small):
    """Small tables as well: neither the specs nor the addresses are sent to the tasks of the other."""
    from wardcraft.plans.queries import _specs
    from wardcraft.plans.views import view

    specs = _specs(spark, small)
    found = match.match_rows(specs, match.prepare_addresses(view(spark, small, "v_addr")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_matches_are_made_last(spark):
    """400 rules that ask for different things, each met by 3,000 addresses: the 1.2 million matches aren't shuffled, with the rules or without."""
    specs = spark.createDataFrame([("B", k % 3, k, 0, "x", "str. a", "numbers", None, [("1", str(40 + k))], None) for k in range(400)], SPEC)
    addresses = match.prepare_addresses(spark.createDataFrame([(f"way:{k}", "Str. A", str(1 + k % 30)) for k in range(3000)], "addr_id string, addr_street string, addr_housenumber string"))
    sc = spark.sparkContext
    sc.setJobGroup("matches", "matches")
    try:
        found = match.match_rows(specs, addresses).agg(F.count(F.lit(1)), F.countDistinct("rule_no"), F.countDistinct(F.substring("addr_id", 5, 1))).first()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert tuple(found) == (1_200_000, 400, 10)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("matches") for s in tracker.getJobInfo(j).stageIds}
    shuffled = [store.lastStageAttempt(s).shuffleWriteRecords() for s in stages]
    assert 3000 < sum(shuffled) < 100_000


@pytest.mark.parametrize("keys", [(), ("town",)])
def test_lots_and_shares(spark, keys, monkeypatch):
    """Kinds in several arrays and streets in several shares: every match is there as often as before."""
    specs, addresses = _rows(spark, keys)
    specs, addresses = specs if keys else specs.drop("town"), addresses.unionByName(addresses.limit(50))
    names = ("rule_no", "sv", "addr_id", "street_norm", "addr_housenumber")
    whole = sorted(map(str, match.match_rows(specs, addresses, keys, names).collect()))
    for name, value in (("LOT", 3), ("MANY", 5), ("PARTS", 3)):
        monkeypatch.setattr(match, name, value)
    assert sorted(map(str, match.match_rows(specs, addresses, keys, names).collect())) == whole and len(set(whole)) < len(whole)


def test_a_column_of_both_tables(spark):
    specs, addresses = _rows(spark, ())
    with pytest.raises(ValueError, match="town"):
        match.match_rows(specs, addresses)
    assert match.match_rows(specs, addresses, columns=("sv", "addr_id")).columns == ["sv", "addr_id"]
