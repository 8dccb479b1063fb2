import random
import re

import numpy as np
import xxhash

from veilspark.llm import simhash


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=2):
    """pairs: (id, fp)"""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(pairs))]


def test_group(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n", "One", "one two", "ONE two three", "É a B\x0bc\xa0d"]
    base = ["w%d" % rnd.randrange(500) for _ in range(400)]
    for i in range(120):
        w = list(base)
        for _ in range(i % 5):
            w[rnd.randrange(len(w))] = "x%d" % rnd.randrange(99)
        texts.append(" ".join(w))
    texts += [" ".join("v%d" % rnd.randrange(30) for _ in range(rnd.randint(1, 30))) for _ in range(80)] + ["same text here again"] * 20 + ["word " * 5000]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, "same text here again"), (None, "only null id of this group"), (5, "dup"), (5, "dup")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    want = [(d, brute_print(t)) for d, t in rows]
    comps = brute_components(want)
    got = simhash.group(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == sorted(map(str, ((d, f"{f:016x}", c) for (d, f), c in zip(want, comps))))
    assert len({c for c in comps if comps.count(c) > 1}) >= 3
    assert simhash.group(docs.limit(0)).count() == 0


def test_links_lose_nothing(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.integers(0, 2**64, 40, dtype=np.uint64)
    fps = {int(c) for c in centres} | {0, 2**64 - 1, 1, 3, 7, 15}
    for c in centres:
        at = int(c)
        for _ in range(25):  # chains: each step flips one or two bits
            for b in rnd.choice(64, rnd.integers(1, 3), replace=False):
                at ^= 1 << int(b)
            fps.add(at)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = brute_components(list(zip(signed, fps)))
    assert [roots.get(s, s) for s in signed] == want


def test_any_blocks_and_chunks_find_the_same(spark):
    """Few blocks, many blocks, and tiles cut into small chunks and slices: the same components."""
    rnd = random.Random(6)
    fps = {rnd.getrandbits(64) for _ in range(40)} | {0, 1, 3, 7}
    for c in list(fps):
        for _ in range(6):
            fps.add(c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    base = rnd.getrandbits(64)
    fps |= {base ^ (1 << i) for i in range(64)}  # one full neighbourhood: many nodes in few tiles
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(list(zip(signed, fps)))
    for blocks, home, visit in ((1, 50, 50), (2, 7, 11), (4, 3, 5), (8, 20_000, 400_000)):
        roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, 2, blocks, home, visit)).collect()}
        assert [roots.get(s, s) for s in signed] == want, blocks


def test_a_star_of_many_rows(spark, monkeypatch):
    """A centre whose rows are more than the heavy share, and one whose are not, give the same components."""
    from veilspark.llm import shared

    edges = [(0, i) for i in range(1, 400)] + [(500 + i, 501 + i) for i in range(0, 60, 2)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {n: 0 for n in range(400)} | {500 + i + j: 500 + i for i in range(0, 60, 2) for j in (0, 1)} | {1000 + i: 1000 for i in range(41)}
    for heavy, easy in ((3, 0), (50_000, 0), (50_000, 2_000_000)):
        monkeypatch.setattr(shared, "HEAVY", heavy)
        monkeypatch.setattr(shared, "EASY", easy)
        assert {r.node: r.root for r in simhash.components(df).collect()} == want
