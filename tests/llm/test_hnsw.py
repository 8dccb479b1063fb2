import numpy as np

from veilspark.llm import hnsw


def brute(rows, k=10):
    """rows: (id, vector) that take part."""
    out = []
    for qid, q in rows:
        if qid % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v in rows if i != qid and len(v) == len(q))
            out += [(qid, r + 1, i, s) for r, (s, i) in enumerate(near[:k])]
    return out


def recall(got, want):
    found = {(r.query_id, r.vec_id) for r in got}
    return sum((q, i) in found for q, _, i, _ in want) / len(want)


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 300)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.3 * rng.normal(size=16)).astype(np.float32).astype(float).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [rows[5]]
    bad = [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [float("inf")] + [1.0] * 15), (3400, [None] + [1.0] * 15), (None, [1.0] * 16), (3500, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as shard")
    use = hnsw.usable(df)
    got = hnsw.search(use, use.filter("vec_id % 100 = 0")).collect()
    want = brute(sorted(set((i, tuple(v)) for i, v in rows)))
    assert recall(got, want) >= 0.9
    exact = {(q, i): s for q, _, i, s in want}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)
    own = {}
    for r in got:
        own.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(own) == {i for i, _ in rows if i % 100 == 0}
    for rs in own.values():
        rs.sort()
        assert [r for r, _, _ in rs] == list(range(1, 11)) and [x[1:] for x in rs] == sorted(x[1:] for x in rs)
    assert [i for _, _, i in own[0]] == list(range(2000, 2010))


def test_few_rows_are_all_found(spark):
    rows = [(i * 100, [float(i + 1), 1.0]) for i in range(5)]
    use = hnsw.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = hnsw.search(use, use.filter("vec_id % 100 = 0")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows))
    assert hnsw.search(use.limit(0), use.limit(0)).count() == 0


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    use = hnsw.usable(df)
    got = hnsw.search(use, use.filter("vec_id % 100 = 0")).collect()
    assert recall(got, brute([(r.vec_id, list(r.v)) for r in use.collect()])) >= 0.98
