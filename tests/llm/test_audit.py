import itertools
import re

import duckdb
import pytest

from wardcraft.llm import audit

SCHEMA = "doc_id long, text string, source string, mask int, part string, fp long, sha string"
COLUMNS = ["part", "filter_order", "step", *audit.COUNTS]


@pytest.fixture(scope="module")
def rows():
    words = " ".join(f"w{k}" for k in range(250))
    texts = [words, words + ".", words.upper(), "a b $", "", None, "a " * 300, "Aa " * 300 + "|", words + " #", "x" * 100_000, "Ünï \x00 日本"]
    docs = [(k, texts[k % len(texts)], ["web", "book", None][k % 3]) for k in range(60)]
    docs += [(None, words, "web"), (None, None, ""), (3, words, "web"), (3, "other", "web"), (3, "other", "web"), (1000, "alone", "rare")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 60, 2)] + [(1, 0, 0), (1, 1, 0), (3, None, 1), (None, 1, 1), (5000, 1, 1)]
    return docs, labels


def _slow(docs, labels):
    found = []
    for doc_id, text, source in docs:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        same = any(i is not None and doc_id is not None and i < doc_id and (x or "") == t for i, x, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": same}
        own = [] if doc_id is None else [x for x in labels if x[0] == doc_id]
        found.append((source or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    out = {}
    for part in {f[0] for f in found}:
        mine, total = [f for f in found if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = mine
            for k, x in enumerate(order):
                here = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                total[x] += len(here)
                fail = [f for f in mine if f[1][x]]
                out[part, order, k + 1] = [len(left), len(here), len(fail) - len(here), sum(sum(f[1].values()) == 1 for f in fail), sum(f[2] for f in here), sum(f[3] for f in here)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("ends", [1 << 20, 0])
def test_audit_against_each_order(spark, rows, ends, monkeypatch):
    monkeypatch.setattr(audit, "MOST_ENDS", ends)  # 0: they are joined, not sent
    docs = spark.createDataFrame([(*d, 1, "p", 2, "s") for d in rows[0]], SCHEMA).repartition(5)
    labels = spark.createDataFrame([(*x, "p") for x in rows[1]], "doc_id long, quality int, toxic int, part string")
    got = audit.filter_audit(spark, docs, labels)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == _slow(*rows)
    assert audit.filter_audit(spark, docs.limit(0), labels).count() == 0
    assert audit.filter_audit(spark, docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_texts_that_share_a_fingerprint(spark, rows):
    """All fingerprints equal, ranges of few rows: texts are told apart, and runs go on from task to task."""
    docs = spark.createDataFrame([(*d, 0) for d in rows[0]], "doc_id long, text string, part string, mask int").selectExpr("7L as fp", "coalesce(text, '') as text", "doc_id", "part", "mask")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.doc_id, r.mask) for r in audit.with_repeats(spark, docs, 4).where("doc_id is not null").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    texts = [(i, t or "") for i, t, _ in rows[0] if i is not None]
    assert got == sorted((i, 16 * any(j < i and x == t for j, x in texts)) for i, t in texts)


def test_query_against_sql(spark, small):
    from wardcraft.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = QUERIES["op13_audit"](spark, small).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op13_audit']}) t").fetchall())
