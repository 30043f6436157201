import hashlib
import random
import re
import zlib

import pytest

from wardcraft.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def _slow(turns):
    """All edits of (role, must, cut), by trying them: the least (cost, audit) and the roles it leaves."""
    best = [(4 * len(turns), "D" * len(turns), ())]  # deleting all is always right

    def go(k, cost, audit, left):
        if cost > best[0][0] or "".join(x[0][:1] for x in left) not in prefixes:
            return
        if k == len(turns):
            if PATTERN.fullmatch("".join(x[0][:1] for x in left)):
                best[0] = min(best[0], (cost, audit, left), key=lambda b: b[:2])
        else:
            role, must, cut = turns[k]
            go(k + 1, cost + 4, audit + "D", left)
            if not must:
                if role:
                    go(k + 1, cost + 3 * cut, audit + "K", (*left, (role, k)))
                for r in NAMES.values():
                    if r != role:
                        go(k + 1, cost + 3 + 3 * cut, audit + "R", (*left, (r, k)))
        if len(audit) < len(turns) + 6:
            for r in NAMES.values():
                go(k, cost + 3, audit + "I", (*left, (r, None)))

    prefixes = {(lead + "ua" * 12)[:n] for lead in ("", "s") for n in range(24)}
    go(0, 0, "", ())
    return best[0]


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def _expected(rows, damaged):
    convs = {r[0] for r in rows}
    for conv in convs:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, n, turns = set(), [0, 0, 0], []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                n[fault] += 1
            turns.append((role, fault < 2, bool(bare) and bare[-1] not in ".!?"))
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, left = _slow(turns)
        text = "\n".join(f"{role}:{'' if k is None else own[k][3]}" for role, k in left)
        yield conv, gaps, *n, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def talks():
    r = random.Random(5)
    texts = ["", " \n", "Yes.", "No!", "Why?", "so", "well. \t", "ok", None, "日本。", "x" * 3000 + "."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.randint(1, 6)):
            rows.append((conv, None if r.random() < 0.1 else turn * r.choice((1, 1, 1, 2)), r.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None)), r.choice(texts)))
    return [*rows, rows[0], rows[3], (99, 7, "user", "lost?")]


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("most", [10_000, 0])
def test_repair_against_all_edits(spark, talks, most, monkeypatch):
    """Also as if all conversations were long ones, in blocks of two turns."""
    monkeypatch.setattr(repair, "BLOCK", 2)
    df = spark.createDataFrame([(*t, 1, "x") for t in talks], "conv_id long, turn long, role string, text string, place long, sha string").repartition(3)
    found = repair.repair(spark, repair.damage(df), most=most)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)
    assert got == sorted(_expected(talks, _damaged(talks)), key=str)
    plain = repair.repair(spark, df, most=most)  # without damage
    assert sorted((tuple(r[c] for c in COLUMNS) for r in plain.collect()), key=str) == sorted(_expected(talks, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in talks]), key=str)
    turns = repair.repaired_turns(df, plain).collect()
    for r in plain.collect():
        lines = [f"{t.role}:{t.text}" for t in sorted((t for t in turns if t.conv_id == r.conv_id), key=lambda t: t.place)]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r.repaired_sha256


def test_blocks_join_to_the_same_ways():
    r = random.Random(1)
    turns = [repair.Turn(k, r.choice("suatx"), r.random() < 0.1, r.random() < 0.1, r.random() < 0.3) for k in range(3000)]
    results = []
    for size in (1, 7, 512, 3000):
        made = repair.Repair()
        for k in range(0, len(turns), size):
            made.add(turns[k : k + size], repair.transfer(turns[k : k + size], repair.STATES))
        results.append(made.result())
    assert all(x == results[0] for x in results)


def test_empty_and_query(spark, small, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").limit(0)
    assert repair.repair(spark, repair.damage(df)).count() == 0
    from wardcraft.llm.queries import QUERIES

    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = QUERIES["op12_repair"](spark, small).collect()
    want = sorted(_expected([tuple(x) for x in rows if x.conv_id % 4 == 1], [x for x in _damaged([tuple(x) for x in rows]) if x[0] % 4 == 1]), key=str)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got if r.conv_id % 4 == 1), key=str) == want
    assert sorted(r.conv_id for r in got) == sorted({x.conv_id for x in rows})
