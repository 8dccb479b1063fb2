import random

import corpus_pipeline
from veilspark.llm import near


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def brute(rows):
    """The kept (id, text) of all components of similar texts."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r), r, key=lambda r: r[0])
    return sorted(map(str, best.values()))


def edited(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = "x%d" % rnd.randrange(10**6)
    return " ".join(out)


def test_near_copies_by_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for size in (60, 200, 900):
        for _ in range(12):  # up to 0.8 and below, more than two bits apart for the most part
            base = ["w%d" % rnd.randrange(10**5) for _ in range(size)]
            rows += [(len(rows) + i, edited(rnd, base, n)) for i, n in enumerate([0, max(1, size // 80), max(1, size // 60), size // 40, size // 25, size // 10])]
    hub = ["h%d" % i for i in range(70)]  # copies that are near to the hub, not always to each other; the hub isn't first
    rows += [(1000 + i, edited(rnd, hub, 1)) for i in range(150)] + [(1200, " ".join(hub))]
    rows += [(2000 + i, " ".join(rnd.choices("abcdef", k=i % 9))) for i in range(60)] + [(3000, None), (3001, " \n"), (3002, "ONE two"), (3003, "one\ttwo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as __nth_")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(str((r.doc_id, r.text)) for r in kept.collect()) == brute(rows)
    assert near.admit(docs.limit(0)).count() == 0


def test_rows_of_one_text(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "x y z w"), (2, "x y z w"), (2, "x y z w"), (9, None)]
    got = near.admit(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, "a b c d"), (2, "x y z w"), (9, None)]))


def test_candidates_of_fingerprints_are_whole(spark, monkeypatch):
    """Operator 4's candidates alone, with no bucket shared, link what is near to it, and are confirmed by similarity."""
    rnd = random.Random(7)
    base = ["w%d" % rnd.randrange(10**5) for _ in range(900)]
    rows = [(i, " ".join([*base, *["tail"] * (i % 2), "x%d" % (i // 2)])) for i in range(6)] + [(9, "other words that stand alone here"), (10, None), (11, ""), (12, "a b"), (13, "b a")]
    monkeypatch.setattr(near, "linked", lambda rows, nodes, _linked=near.linked: _linked(rows, nodes.withColumn("buckets", near.F.transform("buckets", lambda x: near.F.xxhash64(x, "node")))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r.doc_id, r.text)) for r in near.admit(docs).collect())
    assert got == brute(rows)
    assert near.fingerprint_pairs(spark.createDataFrame([(1, [5], 0), (2, [6], 0), (3, [7], 3), (4, [8], 255), (5, [], 0)], "node long, buckets array<long>, fp long")).orderBy("a", "b").collect() == [(1, 2), (1, 3)]
