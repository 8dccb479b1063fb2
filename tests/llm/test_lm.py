import math
import random

import numpy as np
from veilspark.llm import lm_score
import xxhash


def test_against_dictionaries(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(["Good", "fine", "text"] if i % 2 else ["bad", "odd\n", "x"], k=rnd.randint(1, 12)))) for i in range(200)]
    rows += [(300, None), (301, ""), (None, "good fine"), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as target", "2 as score")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(100)] + [(1, 1, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    good = {i for i in range(100) if i % 2 and i != 3}

    def cells(text):
        ws = [xxhash.xxh64_intdigest(w) % lm_score.WORDS for w in (text or "").lower().encode().split()]
        return ws, lm_score.pairs(np.array(ws, np.int64), np.array([0] if ws else [], np.int64)).tolist()

    models = []
    for member in (lambda i: i in good, lambda i: True):
        one, two = {}, {}
        for i, t in rows:
            if member(i):
                ws, ps = cells(t)
                for w in ws:
                    one[w] = one.get(w, 0) + 1
                for p in ps:
                    two[p] = two.get(p, 0) + 1
        models.append((one, two))
    got = lm_score.score(docs, labels, leave_out=False).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        ws, ps = cells(t)
        want = []
        for one, two in models:
            total = sum(one.values()) + lm_score.FLAT * lm_score.WORDS
            bits = 0
            for k, (w, p) in enumerate(zip(ws, ps)):
                alone = (one.get(w, 0) + lm_score.FLAT) / total
                v = one.get(ws[k - 1], 0) if k else 0
                bits -= math.log2(0.5 * min(two.get(p, 0), v, one.get(w, 0)) / v + 0.5 * alone if v else alone)
            want.append(bits / max(1, len(ws)))
        assert by[i].n_tokens == len(ws) and math.isclose(by[i].target_loss, want[0], abs_tol=1e-9) and math.isclose(by[i].score, want[0] - want[1], abs_tol=1e-9)
    scores = [by[i].score for i in range(200)]
    assert max(scores[1::2]) < min(scores[::2])
    assert lm_score.score(docs.limit(0), labels).count() == 0
    assert lm_score.score(docs, labels.limit(0)).count() == len(rows)
