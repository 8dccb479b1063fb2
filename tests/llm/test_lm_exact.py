import collections
import math
import random

from veilspark.llm import lm_score


def test_counts_without_hashing(spark):
    """More words than can be told apart in 2^18 cells, over many chunks, against plain dictionaries."""
    rnd = random.Random(7)
    rows = [(i, " ".join("W%d" % int(rnd.paretovariate(0.25) % 40_000) for _ in range(rnd.randint(0, 80)))) for i in range(1500)] + [(None, "w1 w2"), (2000, None), (3, "w1 w2 w1")]
    good = {i for i in range(0, 1500, 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(1000)] + [(i, 1, 0) for i in good if i >= 1000], "doc_id long, quality int, toxic int")
    split = [(i, (t or "").lower().split()) for i, t in rows]
    models = []
    for member in (lambda i: i in good, lambda i: True):
        texts = [ws for i, ws in split if member(i)]
        models.append((collections.Counter(w for ws in texts for w in ws), collections.Counter(p for ws in texts for p in zip(ws, ws[1:]))))
    assert len(models[1][0]) > 8000
    want = []
    for i, ws in split:
        out = []
        for one, two in models:
            total, bits = sum(one.values()) + lm_score.FLAT * max(lm_score.WORDS, len(models[1][0])), 0
            for before, w in zip([None, *ws], ws):
                alone, v = (one[w] + lm_score.FLAT) / total, one[before] if before else 0
                bits -= math.log2(0.5 * two[before, w] / v + 0.5 * alone if v else alone)
            out.append(bits / max(1, len(ws)))
        want.append((-1 if i is None else i, len(ws), *out))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in lm_score.score(docs, labels, 5000, leave_out=False).collect())
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want)):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-9) and math.isclose(a[3], b[3], abs_tol=1e-9)


def test_leave_one_out(spark):
    """Each document by models counted over all the others, against plain dictionaries."""
    rnd = random.Random(8)
    rows = [(i, " ".join("w%d" % int(rnd.paretovariate(0.5) % 300) for _ in range(rnd.randint(0, 40)))) for i in range(120)] + [(500, "w1 w2 w1 w2"), (None, "w1 w2"), (501, None)]
    rows += [(i + 1000, t) for i, t in rows[:5]]  # copies
    good = set(range(0, 60, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    split = [(t or "").lower().split() for _, t in rows]
    vocabulary = max(lm_score.WORDS, len({w for ws in split for w in ws}))
    want = []
    for k, (i, _) in enumerate(rows):
        out = []
        for member in (lambda i: i in good, lambda i: True):
            texts = [ws for j, ws in enumerate(split) if j != k and member(rows[j][0])]
            one, two = collections.Counter(w for ws in texts for w in ws), collections.Counter(p for ws in texts for p in zip(ws, ws[1:]))
            total, bits = sum(one.values()) + lm_score.FLAT * vocabulary, 0
            for before, w in zip([None, *split[k]], split[k]):
                alone, v = (one[w] + lm_score.FLAT) / total, one[before] if before else 0
                bits -= math.log2(0.5 * two[before, w] / v + 0.5 * alone if v else alone)
            out.append(bits / max(1, len(split[k])))
        want.append((-1 if i is None else i, len(split[k]), *out))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in lm_score.score(docs, labels, 700).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-9) and math.isclose(a[3], b[3], abs_tol=1e-9), (a, b)


def test_packing_is_reversible():
    import numpy as np

    rng = np.random.default_rng(1)
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 1000):
            x = rng.integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True)
            assert (lm_score.unpacked(lm_score.packed(x), kind) == x).all()
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    back = [np.cumsum(lm_score.unpacked(k, np.uint64), dtype=np.uint64) for _, k, _ in lm_score.requests(keys, [np.ones(len(keys))], 7)]
    assert len(back) == 7 and (np.concatenate(back) == keys).all()
