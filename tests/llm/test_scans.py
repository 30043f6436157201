import base64
import gzip
import hashlib
import random
import re
import time
import urllib.parse
import zlib

import pytest

from wardcraft.llm import decontaminate, licences, secrets, warc

RAW = 'password = "hunter2hunter2"'
B64 = lambda x: base64.b64encode(x).decode()


@pytest.mark.parametrize("wrapped", [B64(RAW.encode()), B64(gzip.compress(RAW.encode())), B64(zlib.compress(RAW.encode())), urllib.parse.quote(B64(RAW.encode())), "".join(f"%{c:02x}" for c in RAW.encode()), "".join(f"\\u{ord(c):04x}" for c in RAW), "".join(f"&#x{ord(c):x};" for c in RAW), B64(B64(RAW.encode()).encode()), B64(gzip.compress(B64(gzip.compress(urllib.parse.quote(RAW).encode())).encode()))])
def test_nested_layers(wrapped):
    text = f"é %41 {wrapped} end"
    base, every = secrets.find_secrets(text)
    found = [s for s in every if s not in base and s[1] == 0]
    assert found and all(6 <= a < b <= 6 + len(wrapped) for a, _, b in found)


def test_spans_map_to_characters():
    base, every = secrets.find_secrets("é" + urllib.parse.quote("ü token=abcdef1"))
    assert not base and every == [(1 + len("%C3%BC%20"), 0, 1 + len(urllib.parse.quote("ü token=abcdef1")))]
    deep = RAW
    for _ in range(12):
        deep = B64(deep.encode())
    assert secrets.find_secrets(deep)[1]
    bomb = B64(gzip.compress(b"a" * 3_000_000))
    assert secrets.find_secrets(bomb, 1_000_000) == secrets.find_secrets(bomb) == ([], [(0, 2, len(bomb))])


def _base(x):
    x = x or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


def test_base_spans_against_plain_patterns(spark, docs, empty, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for x in [*texts, "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 20, "Token:'abcdef' PASSWD=\"abc\" api_key = x=y=z=1", "ſecret=abcdefgh", "f" * 24 + "g" + "0" * 23]:
        base, every = secrets.find_secrets(x or "")
        assert base == _base(x) and set(base) <= set(every)
    got = {r.doc_id: r for r in secrets.scan_documents(docs).collect()}
    assert got[4].spans == got[5].spans == [] and secrets.scan_documents(empty).count() == 0
    row = secrets.op5_secrets(spark, small).first()
    assert len(row.base_sha256) == 64 and set(row.asDict()) >= {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}
    assert hashlib.sha256(b"").hexdigest() == row.base_sha256 or row.spans


def test_words_and_phrases_against_plain_python(spark, docs, corpus, empty, small):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    extra = ["CC BY cc-by", "ccé by", "all rights  reserved all rights reserved", "general public licenses", "İ cc\nby", None]
    for x in [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + extra + [t for _, t in corpus]:
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        places = sorted((k, label) for p, label in licences.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        n, base, _ = licences.scan((x or "").encode())
        assert (n, sorted(base)) == (len(w), places), x
    got = {r.doc_id: r for r in licences.scan_documents(docs).collect()}
    assert (got[4].n_words, got[4].base, got[4].score) == (0, [], 0.0) and licences.scan_documents(empty).count() == 0


def test_templates():
    labels = lambda x: {t[2] for t in licences.scan(x.encode())[2]}
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0", "apache"}
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl-notice"}
    assert labels("licensed under the GNU General Public License as published by the Free Software Foundation; either version 2 or (at your option) any later version") == {"gpl-notice"}
    assert labels("Licensed under CC BY-NC-SA 4.0") == {"cc-notice"} and labels("licensed under a Creative Commons Attribution license CC BY 4.0") == {"cc-by-notice"}
    assert labels("licensed under the great Apache License version 2.0") == set()
    assert labels("Copyright (c) 2020 Some One. All rights reserved.") == {"copyright"}
    assert labels("Copyright (c) 20 Some One. All rights reserved.") == set()
    for template in licences.TEMPLATES.values():
        assert any(m.decode() in re.sub("<<optional>>.*?<</optional>>", "", template) for m in licences._MUST)
    with pytest.raises(ValueError):
        licences.Automaton("a <<optional>> b")


def _plain(template, holder="The Example Authors"):
    """A text of a template: with its optional regions, a holder for words of any number, and the least other words."""
    fill = {"scheme": "https", "what": "program", "version": "3", "verb": "disclaims", "years": "2020", "terms": "nc"}
    text = re.sub(r"<<var (\w+)[^<>]*>>", lambda m: fill.get(m[1], holder), template)
    return re.sub(r"<</?optional>>", " ", text)


def test_one_pass_finds_what_each_start_finds():
    r = random.Random(11)
    automata = {k: licences.Automaton(v) for k, v in licences.TEMPLATES.items()}
    readings = [licences.WORD.findall(re.sub("<<[^>]*>>", " 2020 ", t).lower().encode()) for t in licences.TEMPLATES.values()]
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 6)):
            x = r.choice(readings)
            a = r.choice((0, 0, r.randrange(len(x))))
            words += x[a : r.choice((len(x), a + r.randint(1, 30)))] + [r.choice([b"copyright", b"all", b"2020", b"as", b"is", b"x"])] * r.randint(0, 3)
        for a in automata.values():
            starts = [k for k, w in enumerate(words) if w in a.first]
            alone = {k: m[0][1] for k in starts if (m := a.matches(words, [k]))}
            got = dict(a.matches(words, starts))
            assert bool(got) == bool(alone)
            assert all(alone[k] <= e for k, e in got.items()) and set(got.values()) <= set(alone.values())


def test_openings_without_end_take_linear_time():
    began = time.time()
    for opening in (b"this software is provided 'as-is', without any express ", b"copyright 2020 a b ", b"permission is hereby granted, free of charge, ", b"redistribution and use in source and binary forms, "):
        licences.scan(opening * (1_000_000 // len(opening)))
    assert time.time() - began < 30
    story = b"Copyright 2020 we tell a story here. " + b"once more " * 8000 + b"All rights reserved."
    n, base, found = licences.scan(story)
    assert not found and licences.covered(n, base, found) < 0.01
    assert [x[2] for x in licences.scan(b"Copyright (c) 1994 The Regents of the University of California and contributors. All rights reserved.")[2]] == ["copyright"]


@pytest.mark.parametrize("label", sorted(licences.TEMPLATES))
def test_full_texts_and_altered_ones(label):
    template = licences.TEMPLATES[label]
    labels = lambda x: {t[2] for t in licences.scan(x.encode())[2]}
    whole = _plain(template)
    assert label in labels(f"Before. {whole.title()} After.") and label in labels(_plain(template, "Ünlü GmbH, of 2 towns"))
    assert label in labels(_plain(re.sub("<<optional>>(?:(?!<<optional>>).)*?<</optional>>", "", template)))
    if len(template) > 200 and label != "apache-2.0" and not label.endswith("notice"):
        words = whole.split()
        for k in range(2, len(words), max(1, len(words) // 15)):
            changed = [*words[:k], "never", *words[k:]]
            if "Example" not in words[max(0, k - 3) : k + 3] and "Authors" not in words[max(0, k - 3) : k + 3]:
                assert label not in labels(" ".join(changed)), k
        assert label not in labels(" ".join(words[: len(words) * 2 // 3]))


def test_long_holders_and_many_notices():
    import time

    labels = lambda x: [t[2] for t in licences.scan(x.encode())[2]]
    assert labels("Copyright (c) 1994 The Regents of the University of California and all of the many contributors. All rights reserved. And on. All rights reserved.") == ["copyright"]
    began = time.time()
    assert labels("copyright 2020 x " * 20_000) == []
    assert time.time() - began < 5


BENCH = [(1, "Alice told Bob that 12 km are 7 miles, and Alice gave Bob 12 apples for 5 dollars yesterday evening."), (2, "two words"), (3, None), (4, ""), (1, BENCH1 := "the quick brown fox jumps over the lazy dog near the river bank today"), (None, "no id at all here in this item of words"), (7, BENCH1), (9, "¿Qué día es mañana, señor Ibáñez, según el calendario de Ávila y de Óscar?")]


def test_templates_catch_reparameterised_items(spark, docs, empty):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string").withColumn("hash", __import__("pyspark").sql.functions.lit(1))
    cases = {
        1: "So: Alice told Bob that 12 km are 7 miles, and Alice gave Bob 12 apples for 5 dollars yesterday evening. End.",
        2: "So: Alice told Carol that 3.5 miles are 9 km, and Alice gave Carol 3.5 apples for 2 euros yesterday evening.",
        3: "So: Alice told Carol that 3 km are 9 miles, and Alice gave Dave 4 apples for 2 dollars yesterday evening.",
        4: "the quick brown fox jumps over a lazy cat",
        5: "x THE QUICK brown fox jumps over the lazy dog, near the river bank today y",
        6: None,
        7: "here are two words",
        8: "words two here",
        9: "SO: ALICE TOLD BOB THAT 12 KM ARE 7 MILES, AND ALICE GAVE BOB 12 APPLES FOR 5 DOLLARS YESTERDAY EVENING. END.",
        10: "so: alice told bob that 12 km are 7 miles, and alice gave bob 12 apples for 5 dollars yesterday evening. end.",
        11: "So: Alice Told Bob That 12 Km Are 7 Miles, And Alice Gave Bob 12 Apples For 5 Dollars Yesterday Evening. End.",
        12: "alice told carol that 12 km are 7 miles, and alice gave dave 12 apples for 5 dollars yesterday evening.",
        13: "Y: ¿QUÉ DÍA ES MAÑANA, SEÑOR IBÁÑEZ, SEGÚN EL CALENDARIO DE ÁVILA Y DE ÓSCAR? İ",
        14: "y: ¿Qué día es mañana, señor Núñez, según el calendario de Élche y de Úrsula?",
    }
    d = spark.createDataFrame([(k, v, 0) for k, v in cases.items()] + [(None, cases[1], 0), (5, cases[5], 0)], "doc_id bigint, text string, place bigint")
    for limit in (decontaminate.FILTER_BYTES, 0):  # with and without sending the hashes to all tasks
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, d, bench, filter_bytes=limit).collect()}
        assert got == {(1, 1), (2, 1), (5, 1), (7, 2), (9, 1), (10, 1), (11, 1), (13, 9), (14, 9)}
    kept = decontaminate.drop_contaminated(spark, d, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["12", "3", "4", "6", "8", "None"] and kept.columns == d.columns
    assert decontaminate.contaminated(spark, empty, bench).count() == 0 == decontaminate.contaminated(spark, docs, bench.limit(0)).count()


def _all_pairs(docs, items):
    """What `contaminated` should give, by comparing every window of every document with every window of every item."""
    d, out = decontaminate, set()
    for i, item in items:
        for form, size, words, windows, whole, own, slots, h, void, _ in d._item(item.encode()):
            for k, text in docs:
                token, other, slot, name = d.template(text.encode())
                if len(token) < size or whole and len(token) != words:
                    continue
                hits = []
                views = [(2, other, slot & False)] if form == 2 else list(d._forms(token, other, slot, name))
                for view, tokens, gaps in views:
                    g = d.window_hashes(other, size) ^ d._LITERAL if view == 2 else d._hashes(tokens, other, gaps, size)[0]
                    for a in range(len(g)):
                        for p in range(len(h)):
                            if g[a] == h[p]:
                                hits.append((a, p, [(int(own[p + x]), int(other[a + x])) for x in range(size) if slots[p + x] and not void[p]], bool(void[p])))
                if d.covered(words, windows, hits, d.COVERAGE):
                    out.add((k, i))
    return out


def test_decontamination_against_all_pairs(spark):
    import random

    r = random.Random(7)
    vocabulary = "alpha beta gamma delta of the and Rome Oslo Paris 12 7 km 300 miles which is following answer red blue".split()
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 6, 14, 25, 40])))) for k in range(40)]
    docs = []
    for k in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
        own = r.choice(items)[1].split()
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(own))
            own[at : at + r.randint(0, 1)] = r.choice([[], [r.choice(vocabulary)], [own[at], "extra"]])
            own = own or ["x"]
        a = r.randrange(len(own))
        docs.append((k, " ".join([*words, *(own if k % 2 else own[a:]), *words[:5]])))
    want = _all_pairs(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (decontaminate.FILTER_BYTES, 0):
        assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark, d, b, filter_bytes=limit).collect()} == want
    assert 40 < len(want) < 4000


def test_items_of_placeholders_and_short_ones(spark):
    numbers = " ".join(map(str, range(0, 900, 3)))
    items = [(1, numbers), (2, "Yes"), (3, "12 + 7 = ?"), (4, "12 km"), (5, "capital of France"), (6, "capital of France"), (7, None), (8, " ".join(["Rome", "Oslo"] * 10))]
    cases = {
        1: " ".join(map(str, range(2000))),
        2: "so: " + numbers + " end",
        3: "Yes, this is a clean document.",
        4: "yes!",
        5: "12 7",
        6: "we went 12 km and 7 miles, 12 + 7 = 19",
        7: "the capital of france is Paris",
        8: "the capital of Spain",
        9: "x " + " ".join(["Bern", "Prag"] * 10),
        10: "12 7 12 7 12 7 " * 50,
        11: "x y " + " ".join(["rome", "oslo"] * 8),
    }
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame(list(cases.items()), "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, docs, bench).collect()} == {(2, 1), (4, 2), (5, 3), (7, 5), (11, 8)}
    assert sorted((r.item_id, r.class_id) for r in decontaminate.item_classes(bench).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8)]


def test_benchmark_passages(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [r.text for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(x in (r.text or "") for x in items)}
    assert {r.doc_id for r in decontaminate.contaminated(spark, docs, bench).collect()} == want


PAGES = [(5, "http://a/1", "x" * 150), (3, "http://a/2\r\nX: y", "x" * 150), (3, "http://a/2", "x" * 150), (9, None, "short"), (8, "u", "short"), (7, "u", None), (None, "u", "x" * 150), (10, "u", "é\r\n\r\nWARC/1.1\r\n" * 4000), (11, "u", "ü" * 50), (12, "u", "ü" * 50), (13, "u", "")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1, "d") for p in PAGES], "page_id bigint, url string, html string, first int, digest string").repartition(3)
    folder = warc.write_warc(spark, pages)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(PAGES)
    for r in got:
        htmls = [(h or "").encode() for i, _, h in PAGES if i == r.page_id]
        if r.record_type == "response":
            assert r.payload in htmls and r.payload_digest == hashlib.sha256(r.payload).hexdigest() and r.refers_to is None
        else:
            assert r.payload is None and r.payload_bytes == len(htmls[0])
    assert sorted((r.page_id or 0, r.refers_to) for r in got if r.record_type == "revisit") == [(0, 3), (5, 3), (12, 11)]
    assert [r.page_id for r in warc.read_warc(spark, folder, "page_id bigint, record_type string").where("record_type = 'revisit' and page_id = 12").collect()] == [12]
    assert warc.read_warc(spark, warc.write_warc(spark, pages.limit(0))).count() == 0


@pytest.mark.parametrize("places", [26, 7])
def test_warc_roles_against_brute_force(spark, monkeypatch, places):
    monkeypatch.setattr(warc, "PLACES", places)  # 7: many payloads share a mark with a repeated one
    rows = [(k, "u", f"{'page' * 30} {k % 90 if k % 3 else 5000 + k}") for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    first = {}
    for k, _, h in rows:
        first.setdefault(h, k)
    want = sorted((k, "response" if first[h] == k else "revisit", first[h] if first[h] != k else -1, hashlib.sha256(h.encode()).hexdigest(), len(h)) for k, _, h in rows)
    got = warc.read_warc(spark, warc.write_warc(spark, pages), "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long").collect()
    assert sorted((r.page_id, r.record_type, -1 if r.refers_to is None else r.refers_to, r.payload_digest, r.payload_bytes) for r in got) == want


def test_unwanted_payloads_stay_packed(tmp_path):
    big = ("payload %d " * 20_000) % tuple(range(20_000))
    raw = b"".join(warc.member(warc.record("response", k, "http://x", big.encode(), "0" * 64, None, "1970-01-01T00:00:00Z")) for k in range(5))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(raw)
    stats: dict = {}
    seen = list(warc.records(f"file://{path}", stats=stats))
    assert len(seen) == 5 and stats == {}
    found = [r.payload() for r in warc.records(f"file://{path}", stats=stats) if r.headers["x-page-id"] == "3"]
    assert found == [big.encode()] and stats == {"inflated": 1}
    foreign = b"".join(gzip.compress(warc.record("response", k, None, b"y" * k, "0" * 64, None, "d")) for k in range(4))
    (tmp_path / "b.warc.gz").write_bytes(foreign)
    assert [r.payload() for r in warc.records(f"file://{tmp_path}/b.warc.gz")] == [b"y" * k for k in range(4)]
    (tmp_path / "c.warc").write_bytes(b"".join(warc.record("response", k, None, b"z" * k, "0" * 64, None, "d") for k in range(4)))
    assert [r.payload() for r in warc.records(f"file://{tmp_path}/c.warc")] == [b"z" * k for k in range(4)]


def test_edited_and_partial_items_are_caught(spark):
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("alo", "emi", "iru", "osa", "uvi", "ane", "ela", "ite", "opu", "ura")][:59]
    item, short = words[:38], words[38:53]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, " ".join(words))], "item_id bigint, text string")
    cases = {
        1: [*item[:20], "extra", *item[20:]],
        2: [*item[:10], *item[11:25], "extra", *item[25:]],
        3: [*short[:7], "other", *short[8:]],
        4: words[25:55],
        5: words[30:43],
        6: words[30:42],
    }
    docs = spark.createDataFrame([(k, f"Before. {' '.join(v)} after.") for k, v in cases.items()], "doc_id bigint, text string")
    got = {r.doc_id for r in decontaminate.contaminated(spark, docs, bench).collect()}
    assert got == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("wrapped", [B64(gzip.compress(gzip.compress(RAW.encode()))), B64(gzip.compress(zlib.compress(RAW.encode()))), urllib.parse.quote(gzip.compress(RAW.encode())), B64(gzip.compress(b"first ") + gzip.compress(RAW.encode())), B64(b"\xe9 caf\xe9 " + RAW.encode()), B64(b"\x01 " + RAW.encode())])
def test_bytes_between_layers(wrapped):
    base, every = secrets.find_secrets(f"x {wrapped} end")
    found = [s for s in every if s not in base and s[1] == 0]
    assert found and all(2 <= a < b <= 2 + len(wrapped) for a, _, b in found)


LONG = ("some words before it, " * 3 + RAW + " and after").encode()
NOISE = base64.b85encode(hashlib.sha512(b"x").digest() * 2) + RAW.encode()


@pytest.mark.parametrize("wrapped", [base64.encodebytes(LONG).decode(), "\r\n".join(re.findall(".{1,64}", B64(LONG))), base64.encodebytes(gzip.compress(NOISE)).decode(), "https://host.io/cb/" + B64(LONG), "id-" + B64(RAW.encode()), "https://host.io/cb/" + B64(gzip.compress(NOISE)), "id-" + B64(zlib.compress(NOISE))])
def test_wrapped_and_glued_base64(wrapped):
    base, every = secrets.find_secrets(f"x {wrapped} end")
    found = [s for s in every if s not in base and s[1] == 0]
    assert found and all(2 <= a < b <= 2 + len(wrapped) for a, _, b in found)


def test_large_layers_are_read_in_blocks():
    noise = "".join(chr(97 + k * k % 26) + " " for k in range(900_000))
    for inner in (noise + RAW, RAW + noise, noise[:1_000_000] + B64(RAW.encode()) + noise):
        for packed in (gzip.compress(inner.encode()), gzip.compress(zlib.compress(inner.encode())), zlib.compress(gzip.compress(b"x ") + gzip.compress(inner.encode()))):
            text = "at " + B64(packed)
            small, large = (secrets.find_secrets(text, n) for n in (600_000, 64 << 20))
            assert small == large and (3, 0, len(text)) in small[1]


def test_spans_of_odd_characters():
    assert secrets.find_secrets("%EF%BF%BDtoken=abcdef1")[1] == [(9, 0, 22)]
    assert secrets.find_secrets("%E2%82token=abcdef1")[1] == [(6, 0, 19)]
    assert secrets.find_secrets("token\\u{3d}abcdef1\\ud83d\\ude00")[1] == [(0, 0, 18)]
    assert secrets.find_secrets("token%252525253Dabcdef1")[1] == [(0, 0, 23)]
    assert secrets.find_secrets("token&#38;#38;#61;abcdef1")[1] == [(0, 0, 25)]
    assert secrets.find_secrets("token\\u005cu005cu003dabcdef1")[1] == [(0, 0, 28)]


@pytest.mark.parametrize("text", ["%" + "25" * 500_000, "%25" * 330_000, "%41" * 330_000, "&" + "#38;" * 250_000, "\\" + "u005c" * 200_000, "eJw" * 100_000, "A" * 1_000_000, "x" * 1_000_000, "a1" * 500_000, "token=" * 150_000, "password " * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.time()
    base, every = secrets.find_secrets(text)
    assert set(base) <= set(every)
    assert time.time() - began < 10


def test_digest_columns_of_scans(spark, small, docs):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = secrets.op5_secrets(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        base, every = _base(texts[r.doc_id]), secrets.find_secrets(texts[r.doc_id])[1]
        line = lambda x: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in x)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest() and r.spans == line(every)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in licences.op6_licences(spark, small).collect():
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id]))
        places = [(k, label) for p, label in licences.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        own = {x[2] for x in licences.scan(texts[r.doc_id].encode())[2]}
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and r.labels == ",".join(sorted({x for _, x in places} | own)) and 0 <= r.score <= 1
    for found in (secrets.scan_documents(docs), licences.scan_documents(docs)):
        assert sorted(str(r.doc_id) for r in found.collect()) == sorted(str(r.doc_id) for r in docs.collect())


@pytest.mark.parametrize("before", [0, 300_000, 2_600_000, 3_200_000, 4_100_000])
def test_stretches_that_cross_a_block(before):
    """A body of about 1.5 MB in an inflated layer above 4 MB, wherever it stands; data that are cut off."""
    r = random.Random(before)
    body = B64(gzip.compress((r.randbytes(500_000).hex()[:1_000_000] + "\n" + RAW + "\n" + r.randbytes(50_000).hex()).encode(), 1))
    layer = ("word " * (before // 5 + 1) + body + " end" + " more" * (3_000_000 // 5)).encode()
    text = "x " + B64(gzip.compress(layer, 1)) + " y"
    base, every = secrets.find_secrets(text)
    assert (2, 0, len(text) - 2) in {(a, k, b) for a, k, b in every}
    half = gzip.compress((RAW + " ").encode() + r.randbytes(4000))
    cut = B64(half[: len(half) // 2])
    assert any(k == 0 for _, k, _ in secrets.find_secrets(f"x {cut}")[1])


def test_a_text_that_repeats_itself_costs_little(spark):
    item, long = "one two three four " * 50, "one two three four " * 6000
    docs = spark.createDataFrame([(1, long), (2, "five six seven eight nine ten " * 3)], "doc_id long, text string")
    began = time.time()
    found = decontaminate.contaminated(spark, docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.coverage) for r in found] == [(1, 7, 1.0)] and time.time() - began < 40
