import re

from wardcraft.llm.simhash import fingerprint


def test_run_against_brute_force(spark, small):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, small)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    keep = {}
    for i, t in sorted(left):
        keep["".join(c.lower() if "A" <= c <= "Z" else c for c in t)] = (i, t)
    left = sorted(keep.values())
    fps = [int.from_bytes(fingerprint(t.encode()), "big") for _, t in left]
    words = [t.encode().lower().split() for _, t in left]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (fps[a] ^ fps[b]).bit_count() <= 3 or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):  # the stage's links
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = [d for k, d in enumerate(left) if find(k) == k and not any(x in d[1] for x in items)]
    assert sorted(r.doc_id for r in got.collect()) == [i for i, _ in left]
    assert got.where("not round_trip").count() == 0


def test_stages_keep_columns_and_take_odd_rows(spark, small, docs, empty):
    import corpus_pipeline

    train = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, empty):
            out = stage(spark, df, small)
            assert out.count() <= df.count(), name
            if name != "sentencepiece":
                assert out.columns == df.columns
        assert stage(spark, train, small).count() > 0


def test_queries_run(spark, small):
    from wardcraft.llm.queries import QUERIES

    table = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    n = table("documents").count()
    others = {"op2_warc": table("pages").count(), "op11_lattice": table("embeddings").count(), "op12_repair": table("conversations").select("conv_id").distinct().count(), "op13_audit": 600 * table("documents").select("source").distinct().count()}
    for name, query in QUERIES.items():
        rows = query(spark, small).count()
        assert rows == others.get(name, n), name
