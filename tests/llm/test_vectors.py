import numpy as np
import pytest

from wardcraft.llm import e8

SCHEMA = "vec_id long, embedding array<float>, label int, node long, code long, h long"


def _near(rng, v, cosine):
    g = rng.normal(size=len(v))
    v = v / np.linalg.norm(v)
    g -= g @ v * v
    return cosine * v + np.sqrt(1 - cosine**2) * g / np.linalg.norm(g)


@pytest.fixture(scope="module")
def vectors():
    """A dense group, chains at 0.951 to 0.99, scaled and equal copies, odd rows."""
    rng = np.random.default_rng(3)
    out = [rng.normal(size=64) for _ in range(300)]
    centre = rng.normal(size=64)
    out += [_near(rng, centre, 0.985) for _ in range(150)]
    for k in range(150):
        out.append(_near(rng, out[k], rng.uniform(0.951, 0.999)))
    out += [out[0] * 3, out[0], out[0], out[5] * -1, rng.normal(size=4)]
    out.append(out[-1] + 0.01)
    rows = [(k * 3, [float(x) for x in v]) for k, v in enumerate(out)]
    odd = [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, [1.0, None]), (2004, [float("inf"), 1.0]), (2005, []), (None, rows[1][1]), (9, rows[3][1]), (2006, [1.0]), (2007, [5.0])]
    return rows + odd


def _brute(rows):
    ok = [v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v) for _, v in rows]
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if good else None for (_, v), good in zip(rows, ok, strict=True)]
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(rows))]
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *[label[j] for j in links[i]]]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        yield rows[i][0], len(links[i]), min(ids, default=None), rows[i][0] == min(ids, default=None)


@pytest.mark.parametrize("part", [1024, 8])
def test_against_all_pairs(spark, vectors, part):
    """Also with cells in parts of 8. The wanted recall is raised so that all links are found: then counts and components are equal."""
    df = spark.createDataFrame([(a, b, 1, 2, 3, 4) for a, b in vectors], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in e8.near_vectors(spark, df, recall=1 - 1e-7, part=part).collect()), key=str)
    assert got == sorted(_brute(vectors), key=str)


def test_recall_and_empty(spark, vectors):
    df = spark.createDataFrame([(a, b, 1, 2, 3, 4) for a, b in vectors], SCHEMA)
    want = {r[0]: r[1] for r in _brute(vectors)}
    got = {r.vec_id: r.n_links for r in e8.near_vectors(spark, df).collect()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.97 * sum(want.values())
    assert e8.near_vectors(spark, df.limit(0)).count() == 0


def test_recall_by_cosine():
    """Pairs at the threshold itself, for the sizes of small and of very many rows."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.stack([_near(rng, x, 0.95) for x in a])
    for rows in (100, 50_000, 10_000_000):
        t = e8.Tables(64, *e8.sizes(rows, 64))
        assert (t.cells(a)[:, :, :, None] == t.cells(b)[:, :, None, :]).any((1, 2, 3)).mean() >= 0.93
    assert e8.sizes(10**9, 64)[0] > e8.sizes(10**6, 64)[0]


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (400, 8))
    near = e8.decode(x)
    assert np.allclose(near * 2, np.rint(near * 2)) and np.allclose(near.sum(1) % 2, 0)
    others = near[:, None, :] + e8.roots()[None]
    assert (((x - near) ** 2).sum(1)[:, None] <= ((x[:, None] - others) ** 2).sum(2) + 1e-12).all()
