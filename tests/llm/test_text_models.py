import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardcraft.llm import langid, lattice, nbest, quality, token_files
from wardcraft.llm.text import is_held_out

MODEL = lattice.default_model()


def test_segments_are_the_normalised_text():
    v = lattice.pieces(MODEL)
    for x in ["", " ", "a", "  a  b\nc \U0001f600  ", "\n\n a", "x▁y"]:
        assert "".join(lattice.segments(x)) == v.model.normalize(x)
    assert "".join(v.split("▁hello,wörld.")) == "▁hello,wörld."


def _paths(v, s):
    """All segmentations of a short text, by recursion."""
    if not s:
        return [(0.0, ())]
    out = []
    for k in range(1, len(s) + 1):
        p = v.ids.get(s[:k])
        if p is not None or k == 1:
            own = (v.scores[p], (p,)) if p is not None else (v.unknown, tuple(v.bytes[b] for b in s[0].encode()))
            out += [(own[0] + score, own[1] + ids) for score, ids in _paths(v, s[k:])]
    return out


@pytest.mark.parametrize("x", ["▁the", "▁hello", "a", "日x", "▁▁▁ab", "▁onthe,the."])
def test_nbest_against_all_paths(x):
    v = lattice.pieces(MODEL)
    every = sorted(_paths(v, x), key=lambda p: -p[0])
    got = nbest.segment_nbest(v, x, 5)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in every[:5]])
    assert set(got) <= set(every) and len(set(got)) == len(got)


def test_nbest_of_texts():
    v = lattice.pieces(MODEL)
    for x in ["ab cd", "a\nb  c", "on it, é"]:
        parts = [_paths(v, p) for p in lattice.segments(x)]
        want = sorted((sum(c[0] for c in choice) for choice in itertools.product(*parts)), reverse=True)
        got = nbest.encode_nbest(x, 4)
        assert [s for s, _ in got] == pytest.approx(want[:4])
        assert all(v.decode(ids) == x for _, ids in got) and len({tuple(i) for _, i in got}) == 4
    assert nbest.encode_nbest("", 3) == [(0.0, [])]


@pytest.mark.parametrize("x", ["x" * 9, "=" * 11, "xxxyyy" * 2, "日" * 6 + "x" * 5])
def test_ties_against_all_paths(x):
    v = lattice.pieces(MODEL)
    every = sorted(_paths(v, x), key=lambda p: -p[0])
    for n in (1, 3, 20):
        got = nbest.segment_nbest(v, x, n)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in every[:n]])
        assert {i for _, i in got} <= {i for _, i in every} and len({i for _, i in got}) == len(got)


@pytest.mark.parametrize("x", ["▁the", "a", "日x", "▁▁▁ab", "▁onthe,the.", "x" * 9, "日" * 6 + "x" * 5, "\U0001f600"])
def test_held_entries_have_the_best_and_the_gap(x):
    v = lattice.pieces(MODEL)
    every = sorted((s for s, _ in _paths(v, x)), reverse=True)
    found = nbest._entry(v)(x)
    score, gap = nbest.ENTRY.unpack_from(found)
    assert score == pytest.approx(every[0]) and gap == (pytest.approx(every[0] - every[1], abs=1e-9) if len(every) > 1 else math.inf)
    assert (every[0], tuple(np.frombuffer(found[16:], np.uint32).tolist())) in [(pytest.approx(s), i) for s, i in _paths(v, x)]


@pytest.mark.parametrize("x", ["x", "=", "-", "xy", "日"])
def test_long_runs_stay_small(x):
    import time
    import tracemalloc

    v = lattice.pieces(MODEL)
    began = time.time()
    assert nbest.encode_nbest("a " + x * 20_000, 3)
    assert time.time() - began < 5
    tracemalloc.start()
    nbest.segment_nbest(v, x * 20_000, 3)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    assert not any(len(k) > nbest.LONGEST for k in nbest._cache(MODEL))


def test_digest_is_of_the_best_segmentation(small):
    import zlib

    import pyarrow.parquet as pq

    v, held = lattice.pieces(MODEL), nbest._cache(MODEL)
    for x in pq.read_table(f"{small}/documents.parquet").column("text").to_pylist():
        got = nbest._digest(x or "", 3, held, v)
        want = nbest.encode_nbest(x or "", 3)
        ids = np.array(want[0][1], np.uint32)
        assert got[0] == len(ids) and got[2] == zlib.crc32(ids.astype("<u4").tobytes()) and got[3] == (v.decode(ids) == (x or ""))
        assert [s for s in got[1] if s is not None] == pytest.approx([s for s, _ in want])


def test_encode_documents(spark, docs, corpus, empty):
    got = nbest.encode_documents(docs).collect()
    assert len(got) == len(corpus) and all(r.round_trip for r in got if r.doc_id != 9)
    for r in got:
        if r.doc_id in (4, 5):
            assert (r.n_pieces, r.ids_crc32, r.scores[0]) == (0, 0, 0.0)
        assert [x for x in r.scores if x is not None] == sorted([x for x in r.scores if x is not None], reverse=True)
    assert nbest.encode_documents(empty).count() == 0
    assert all(s.decoded == "a" for r in nbest.encode(docs.where("text = 'a'")).collect() for s in r.segmentations)


def test_forward_sums_all_segmentations():
    v = lattice.pieces(MODEL)
    p = np.random.default_rng(0).random((2, len(v.scores)))
    p /= p.sum(1, keepdims=True)
    m = langid.Model(MODEL, ["a", "b"], p)
    for x in ["▁the", "▁hello", "a日", "▁▁▁ab"]:
        for k in (0, 1):
            total = sum(math.prod(float(m.probabilities[k][i]) if i not in v.bytes else 1 for i in ids) * (m.unknown if any(i in v.bytes for i in ids) else 1) for _, ids in _paths(v, x))
            assert m.segment(x)[k] == pytest.approx(math.log(total), rel=1e-5)
        assert lattice.piece_table(MODEL).forward([x, "▁zz"], p.T, m.unknown)[0] == pytest.approx(m.segment(x), rel=1e-4)
    long = "▁" + "x日" * 3000
    assert np.isfinite(m.scores([long])[0]).all()


def test_expected_counts_against_all_paths():
    v = lattice.pieces(MODEL)
    p = np.random.default_rng(1).random(len(v.scores))
    p /= p.sum()
    counts, u = {"▁the": 3, "▁hello": 1, "a日": 2, "▁▁ab": 5}, 1e-7
    want = np.zeros(len(p))
    for x, times in counts.items():
        paths = [(ids, math.prod(p[i] if i not in v.bytes else 1 for i in ids) * (u if any(i in v.bytes for i in ids) else 1)) for _, ids in _paths(v, x)]
        for ids, own in paths:
            for i in ids:
                if i not in v.bytes:
                    want[i] += times * own / sum(w for _, w in paths)
    assert langid._expected(v, counts, p, u) == pytest.approx(want, rel=1e-9)
    long = "ab" * 400  # its sum is far under the least float
    got = langid._expected(v, {long: 1}, p, u)
    assert sum(got[i] * len(t) for t, i in v.ids.items()) == pytest.approx(len(long), rel=1e-6)


def test_predictions_against_all_paths(spark, small):
    train = [("the cat sat", "en"), ("der hund lief", "de"), ("el gato", "es"), ("the cat sat", "en"), (None, "en"), ("x", None)]
    m = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    assert m.languages == ["de", "en", "es"]
    v, u = lattice.pieces(MODEL), m.unknown
    texts = ["the cat", "hund", "gato el", "2 ²½①Ⅷ₂", "", "日 the", "the\nhund"]
    got = m.predict(texts)
    for x, (lang, score) in zip(texts, got, strict=True):
        if not any(c.isalpha() for c in x):
            assert (lang, score) == ("und", 0.0)
            continue
        logs = [sum(math.log(sum(math.prod(float(q[i]) if i not in v.bytes else 1 for i in ids) * (u if any(i in v.bytes for i in ids) else 1) for _, ids in _paths(v, s))) for s in lattice.segments(x)) for q in m.probabilities]
        assert lang == m.languages[int(np.argmax(logs))] and score == pytest.approx(1 / sum(math.exp(y - max(logs)) for y in logs), rel=1e-4)
    assert [x[0] for x in got[:3]] == ["en", "de", "es"]


def test_long_segments_take_linear_time():
    import time

    v = lattice.pieces(MODEL)
    p = np.random.default_rng(0).random((2, len(v.scores)))
    m = langid.Model(MODEL, ["a", "b"], p / p.sum(1, keepdims=True))
    for x in ("ab", "x", "x日"):
        began = time.time()
        assert np.isfinite(m.scores([x * 50_000])[0]).all()
        assert time.time() - began < 6


def test_language_accuracy_and_odd_rows(spark, docs, empty, small):
    every = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = langid.fit(every.where(~is_held_out(F.col("doc_id"))), 60)
    got = langid.predict(spark, every, model).join(every.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert got.a > 0.98
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark, docs, model).collect()}
    assert odd[4] == odd[5] == odd[6] == ("und", 0.0) and all(0 <= s <= 1 for _, s in odd.values())
    assert langid.predict(spark, empty, model).count() == 0
    kept = langid.keep_known(spark, docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (4, 5, 6)").count() == 0 and kept.where("doc_id = 7").count() == 1
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(spark, docs, none).collect()} == {"und"}


def test_quality_accuracy_and_odd_rows(spark, docs, empty, small):
    d = small.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(spark, spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    r = got.select(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("a")).first()
    assert r.a > 0.98
    odd = quality.classify(spark, docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.classify(spark, empty, labels).count() == 0
    assert {r.predicted for r in quality.classify(spark, docs, labels.limit(0)).collect()} == {1}


def test_fit_against_plain_moments(spark, small):
    """statistics and fit against plain sums over the labelled rows."""
    import zlib

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    used = [(marks[i], quality.statistics(t.encode())) for i, t in rows if i in marks and zlib.crc32(str(i).encode()) % 4 != 2]
    moments = {}
    for k in (0, 1):
        x = np.array([[1.0, *s] for y, s in used if y == k])
        moments[k] = sum(np.outer(v, v) for v in x)
    want = quality.Discriminant(moments).score(np.array([quality.statistics(t.encode()) for _, t in rows]))
    got = {r.doc_id: r for r in quality.classify(spark, docs, labels).collect()}
    assert [got[i].score for i, _ in rows] == pytest.approx(want.tolist(), abs=1e-9)
    assert all(got[i].predicted == int(s >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for (i, _), s in zip(rows, want, strict=True))


def test_statistics_against_plain_counts():
    for text in ("", "A b!\n\nc c c | - 12 é", "x" * 50):
        raw, words = text.encode(), text.split()
        got = dict(zip(quality.NAMES, quality.statistics(raw), strict=True))
        logit = lambda p: math.log((p + 0.01) / (1.01 - p))
        n, k = len(raw), max(1, len(words))
        assert got["log_bytes"] == pytest.approx(math.log(1 + n)) and got["log_words"] == pytest.approx(math.log(1 + len(words))) and got["word_length"] == pytest.approx(math.log(1 + n / k))
        assert got["upper"] == pytest.approx(logit(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / max(1, n))) and got["high"] == pytest.approx(logit(sum(b > 127 for b in raw) / max(1, n)))
        assert got["top_word"] == pytest.approx(math.sqrt(max((words.count(w) for w in words), default=0) / k)) and got["bare"] == pytest.approx(math.sqrt(sum(w in "|-" for w in words) / k))
        lines = [x for x in text.split("\n") if x.strip()]
        assert got["line_copies"] == pytest.approx(math.sqrt(1 - len(set(lines)) / max(1, len(lines))))


def test_discriminant_is_a_density_ratio():
    r = np.random.default_rng(3)
    rows = {k: r.normal(size=(400, len(quality.NAMES))) * (1 + k) + k for k in (0, 1)}
    m = {k: np.c_[np.ones(len(x)), x].T @ np.c_[np.ones(len(x)), x] for k, x in rows.items()}
    q = quality.Discriminant(m, 0.0, 0.0, 0.0)
    x = rows[1][:5]
    log = []
    for k in (0, 1):
        mean, cov = rows[k].mean(0), np.cov(rows[k].T, bias=True)
        log.append([-0.5 * ((y - mean) @ np.linalg.solve(cov, y - mean) + np.linalg.slogdet(cov)[1]) for y in x])
    assert q.score(x) == pytest.approx(1 / (1 + np.exp(np.array(log[0]) - log[1])), rel=1e-6)


def test_token_coding():
    for n in (0, 1, 3, 4, 5, 1000):
        v = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32) >> np.random.default_rng(n + 1).integers(0, 32, n).astype(np.uint32)
        control, data = token_files.pack(v)
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == v).all()


def test_words_are_encoded_as_the_library_does():
    import public_tokenizers

    e = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " ", "  ", "a  b", "a \n b", " x", "x ", "a\n\n b", "it's  'll <|endoftext|> x", "a .. b.. c., d.\nE f,\nG\n\ni j.\n k\nL\nM é.\nÉ 5.\nX", "a\x1c b \x1cc", "​ x ᠎ y  z", "\U0001f600 日本 語.", "x" * 5000]
    assert [np.frombuffer(x, e.kind).tolist() for x in e.ids(odd)] == [e.library.encode(x, add_special_tokens=False).ids for x in odd]


def test_mixed_words_are_encoded_as_the_library_does():
    import random

    import public_tokenizers

    e, rng = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    signs = ["a", "B", "ab", "\u00e9", "\u00d7", "\u00f7", "\u00d7a", "\u03a9", "\u0439", "\u0482", "\u024f", "\u4e2d", "1", "\u0663", "'", "'s", "'re", " ", " ", " ", "  ", "\n", "\n\n", "\r\n", "\t", ".", ",", "!!", "$", "-", "_", "\u2019", "\u0301", "\x85", "\u2028", "\xa0", "\x1c", "\U0001f600", "\u200d", "<|endoftext|>", "\u00aa", "\u01c5"]
    for _ in range(4):
        batch = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(1500)]
        assert [np.frombuffer(x, e.kind).tolist() for x in e.ids(batch)] == [x.ids for x in e.library.encode_batch_fast(batch, add_special_tokens=False)]
    assert e.ids([]) == []


def test_token_files(spark, docs, corpus, empty):
    folder = token_files.write_tokens(spark, docs, block_tokens=50)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    library = token_files.tokenizer(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    want = sorted(str((i, [*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in corpus)
    assert sorted(str((r.doc_id, list(r.ids))) for r in got) == want
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert token_files.read_tokens(spark, token_files.write_tokens(spark, empty)).count() == 0


def test_op1_digests_are_those_of_whole_texts(spark, small):
    """Every column of the query against the tokenizers library on each whole text."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from wardcraft.llm.queries import QUERIES

    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_tokens"](spark, small).collect()) == want
