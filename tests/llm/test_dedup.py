import hashlib
import random

import numpy as np
import pytest
import xxhash

from wardcraft.llm import exact, simhash


def _lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


def test_filter_round_trip_and_merge():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 500, n).astype(np.uint64) << np.uint64(48) | r.integers(0, 3, n).astype(np.uint64) for n in (0, 1, 700, 900)]
    made = []
    for p in parts:
        fps, counts = exact.summed(np.sort(p), np.ones(len(p), np.int64))
        f = exact.CountingQuotientFilter.from_bytes(exact.CountingQuotientFilter.of(fps, counts, 64).to_bytes())
        assert all((a == b).all() for a, b in zip(f.items(), (fps, counts), strict=True))
        made.append(f)
    fps, counts = exact.CountingQuotientFilter.merge(made).items()
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert (fps == want[0]).all() and (counts == want[1]).all()


def test_exact_against_brute_force(spark, docs, corpus, empty, monkeypatch):
    monkeypatch.setattr(exact, "RANGE_ROWS", 4)  # several ranges
    groups = {}
    for i, t in corpus:
        groups.setdefault(_lower(t), []).append(i)
    got = exact.exact_duplicates(spark, docs).collect()
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(i, keep, len(ids), sha) for i in ids]
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    key = lambda x: tuple(str(y) for y in x)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert exact.exact_duplicates(spark, empty).count() == 0
    kept = exact.drop_exact_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [2, 3, 5, 6, 7, 8, 9, 10, 10, 11, 12]
    assert kept.where("doc_id is null").count() == 2


def _slow(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    n = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > len(s))


def _components(values, ids, bits=3):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_fingerprints_and_components(spark, docs, corpus, empty):
    fps = [_slow(t) for _, t in corpus]
    assert [int.from_bytes(simhash.fingerprint((t or "").encode()), "big") for _, t in corpus] == fps
    got = simhash.near_duplicates(spark, docs).collect()
    want = [(i, f - (1 << 64) if f >> 63 else f, c) for (i, _), f, c in zip(corpus, fps, _components(fps, [i for i, _ in corpus]), strict=True)]
    assert sorted(map(str, ((r.doc_id, r.fp, r.component_id) for r in got))) == sorted(map(str, want))
    assert simhash.near_duplicates(spark, empty).count() == 0
    kept = simhash.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert kept.where("doc_id is not null").groupBy("doc_id", "text").count().where("count > 1").count() == 0


@pytest.mark.parametrize("spread,n,most", [(12, 700, 256), (20, 900, 256), (9, 400, 100_000)])
def test_dense_groups_lose_no_link(spark, spread, n, most):
    """Postings above the limit are dealt out again; the components stay those of all pairs."""
    r = random.Random(spread)
    places = r.sample(range(64), spread)
    values = sorted({sum(1 << p for p in places if r.random() < 0.3) for _ in range(n)} | {r.getrandbits(64) for _ in range(50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.similar_fingerprints(spark, spark.createDataFrame([(v,) for v in signed], "fp bigint"), 3, most)
    pairs = [(x.u, x.v) for x in links.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in pairs)
    assert len(pairs) < 14**3 * len(values)
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(v) for v in signed] == _components([v & (2**64 - 1) for v in signed], signed)


def test_every_five_shared_bytes_share_a_posting():
    import itertools

    for level, fixed in ((0, 0), (1, simhash.masks()[3])):
        assert all(any(not set(gone) & set(b) for b in simhash.BLOCKS) for gone in itertools.combinations(range(8), 3))
        assert len({*simhash.masks(fixed, level)}) == 14 and all(m & fixed == fixed for m in simhash.masks(fixed, level))


def test_near_copies_against_brute_force(spark, docs, empty, small):
    from wardcraft.llm import shingles

    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    long = [f"w{k}" for k in range(200)]
    edited = [" ".join([*long[:k], f"x{k}", *long[k + 1 :]]) for k in range(10, 190, 2)]  # 5 of 196 shingles each
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(10_000 + k, t) for k, t in enumerate(edited)] + [(None, edited[0]), (20_000, None), (20_001, " ")]
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = [int.from_bytes(simhash.fingerprint((t or "").encode())) for _, t in rows]
    near = 0
    for a in range(len(rows)):
        for b in range(a):
            n = len(s[a] & s[b])
            alike, close = n >= 0.8 * (len(s[a]) + len(s[b]) - n), (fps[a] ^ fps[b]).bit_count() <= 3
            near += alike and not close
            if alike or close:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert near  # links that 3 bits don't give
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (shingles.MOST, 20, 3):  # the small ones: postings dealt out in chunks, and what is left of them in blocks
        got = shingles.near_copies(spark, df, most=most).collect()
        assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(str((i, least[find(k)])) for k, (i, _) in enumerate(rows)), most
    kept = shingles.drop_near_copies(spark, docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert shingles.near_copies(spark, empty).count() == 0


def test_positional_bytes_agree_as_often_as_sets_do():
    from wardcraft.llm import shingles

    r = np.random.default_rng(2)
    shared, lost = [], 0
    for _ in range(300):
        x = r.integers(0, 1 << 63, 220).astype(np.uint64)
        a, b = shingles.positional(np.sort(x[:200])), shingles.positional(np.sort(np.r_[x[:178], x[200:222]]))  # 178 of 220 to 222: just over 0.8
        shared.append(int((a == b).sum()))
        lost += not np.intersect1d(shingles.bands(a), shingles.bands(b)).size or shared[-1] < shingles.least_shared(0.8)
    assert 98 < np.mean(shared) < 103 and not lost


def test_links_within_takes_known_components_for_granted():
    from wardcraft.llm import shingles

    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = [np.unique(np.r_[base[:95], r.integers(0, 1 << 63, 3).astype(np.uint64)]) for _ in range(40)] + [np.unique(r.integers(0, 1 << 63, 50).astype(np.uint64)) for _ in range(5)]
    fps = np.array([shingles.positional(s) for s in sets])
    assert len(shingles.links_within(fps, sets, 0.8)) == 39
    label = np.array([7] * 30 + [8] * 10 + [1, 2, 3, 4, 5])
    found = shingles.links_within(fps, sets, 0.8, label)
    assert len(found) == 1 and all({a < 30, b < 30} == {True, False} for a, b in found)
