"""Near duplicates of the pipeline: texts with 0.8 or more of their five-word shingles in common.

1. Texts with the same set of shingles are one node (`signatures`); a node has operator 4's fingerprint
   over these shingles, and `BANDS` band hashes of `ROWS` minima of its set.
2. Nodes whose fingerprints operator 4 links (`simhash.links`) are candidates (`fingerprint_pairs`). Most
   pairs of similarity 0.8 differ in more bits than its radius, so those that share a band hash meet in a
   bucket besides. Every candidate, of either kind, is confirmed by the exact Jaccard similarity of the sets.
3. In each bucket some nodes, those with most company in all their buckets first, meet all others that
   aren't in their component yet: by size and a sketch of minima, and where these allow for it, by
   the exact similarity. They are then done, and rounds with more of them follow
   until each pair of a bucket has met or is in one component. So no pair is skipped, a large group
   around one text takes one round, and texts that share a passage alone never become pairs.
4. Sets are built for nodes with candidates alone, once, and sketches for those in buckets; components are those of `simhash.components`.

A pair of similarity s shares no bucket with chance (1 - s^ROWS)^BANDS: 0.0004 at 0.8, 0.00001 at 0.85.
Shingles are of lower-cased words as in operator 4 and are compared by 64-bit hashes. Fewer words
than a shingle's are one shingle; texts without words are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, release, ship, slices, spread_join, strings
from .simhash import components, fingerprint, first_rows, identified, links

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
#: Nodes of a bucket compared with the others in the first round, and by how much that grows each round.
PIVOTS, MORE = 1, 16
#: Bits of a sketch, its numbers, and most bits that differ between sets that are compared: of 2048 bits of
#: sets of similarity 0.8 a tenth differs, over 269 with a chance of 10^-6; at 0.7 one pair in 100 passes.
BITS, UNLIKE = 2048, 269
WORDS = -(-BITS // 56)
#: Distinct words in a worker's memo beyond which it starts anew (memory only).
MEMO = 100_000
_MEMO: dict[bytes, int] = {}
_DRAW = np.random.default_rng(42)
_PLACE = _DRAW.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _DRAW.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _DRAW.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_MORE_TIMES = _DRAW.integers(0, 1 << 31, (BITS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_MORE_PLUS = _DRAW.integers(0, 1 << 32, (BITS, 1), np.uint32)
_ROW = _DRAW.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    if len(_MEMO) > MEMO:
        _MEMO.clear()
    split = [(t or "").encode().lower().split() for t in texts]  # bytes: A-Z only, and ASCII white space only
    flat = [w for ws in split for w in ws]
    for w in set(flat).difference(_MEMO):
        _MEMO[w] = xxhash.xxh64_intdigest(w)
    words = np.fromiter(map(_MEMO.__getitem__, flat), np.uint64, len(flat))
    whole = max(0, len(words) - SHINGLE + 1)
    every = _mix(sum((words[k : whole + k] * _PLACE[k] for k in range(SHINGLE)), np.zeros(whole, np.uint64)))
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= SHINGLE:
            out.append(np.unique(every[at : at + n - SHINGLE + 1]))
        else:
            out.append(_mix((words[at : at + n] * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else words[:0])
        at += n
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS * ROWS): the least of each of the hashes over each set; of no meaning for an empty set."""
    least = np.zeros((len(sets), BANDS * ROWS), np.uint32)
    for i, s in enumerate(sets):
        if len(s):
            part = (s >> np.uint64(32)).astype(np.uint32)
            least[i] = np.min([(part[j : j + 20_000] * _TIMES + _PLUS).min(1) for j in range(0, len(part), 20_000)], 0)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """(sets, BANDS): the band hashes."""
    rows = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    return _mix(_mix((rows + np.uint64(1)) * _ROW).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def looks(sets: DataFrame) -> DataFrame:
    """node, sketch (a bit of each of BITS further minima of its set, 56 to a number) and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
            bits = np.zeros((len(rows), WORDS * 56), np.uint8)
            for i, s in enumerate(rows):
                if len(s):
                    part = (s >> np.uint64(32)).astype(np.uint32)
                    least = np.full(BITS, 0xFFFFFFFF, np.uint32)
                    for j in range(0, len(part), 1000):
                        np.minimum(least, (part[j : j + 1000] * _MORE_TIMES + _MORE_PLUS).min(1), out=least)
                    bits[i, :BITS] = _mix(least.astype(np.uint64) + np.uint64(1)) >> np.uint64(63)
            wide = np.zeros((len(rows), WORDS, 8), np.uint8)
            wide[:, :, :7] = np.packbits(bits, axis=1, bitorder="little").reshape(len(rows), WORDS, 7)
            numbers = wide.reshape(len(rows), -1).view("<i8").astype(np.int64).ravel()
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WORDS), pa.array(numbers))
            yield pa.RecordBatch.from_arrays([batch.column("node"), sketch, pa.array([len(s) for s in rows], pa.int32())], names=["node", "sketch", "size"])

    return sets.mapInArrow(run, "node long, sketch array<long>, size int")


def plausible(own: Column, other: Column) -> Column:
    """Whether two structs of sketch and size may stand for similar sets: sizes within the similarity, and
    few enough bits that differ."""
    unlike = F.aggregate(F.zip_with(own["sketch"], other["sketch"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)
    return (F.least(own["size"], other["size"]) >= SIMILAR * F.greatest(own["size"], other["size"])) & (unlike <= UNLIKE)


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, node (hash of the set of shingles), its buckets (none without words) and the text's fingerprint."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in strings(batch, "text")]
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b])
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([BANDS * (len(s) > 0) for s in sets])]).astype(np.int32)
                own = bands(minima(sets))[[len(s) > 0 for s in sets]].ravel().view(np.int64)
                fp = np.array([fingerprint(t, SHINGLE) for t in texts[a:b]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(node), pa.ListArray.from_arrays(pa.array(ends), pa.array(own)), pa.array(fp)], names=["doc_id", "node", "buckets", "fp"])

    out = rows.select("doc_id", F.lit(0).cast("long").alias("node"), F.array().cast("array<long>").alias("buckets"), F.lit(0).cast("long").alias("fp")).schema
    return rows.select("doc_id", "text").mapInArrow(run, out)


def sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its set of shingles, of the nodes `wanted` (node, least: one of its rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in strings(batch, "text")]
            for a, b in slices(texts):
                sets = pa.array([s.tobytes() for s in shingle_sets(texts[a:b])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), sets], names=["node", "shingles"])

    found = rows.join(wanted, F.col("doc_id") == F.col("least")).select("node", "text").dropDuplicates(["node"])
    return found.mapInArrow(run, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, and the roots __r and __s that they would join) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                if min(len(p), len(q)) >= SIMILAR * max(len(p), len(q)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep[i] = both >= SIMILAR * (len(p) + len(q) - both)
            yield batch.select(["a", "b", "__r", "__s"]).filter(pa.array(keep))

    one, other = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "__r", "__s", "x", "y").mapInArrow(run, "a long, b long, __r long, __s long")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: operator 4's links among the nodes' fingerprints, each by the least node of either fingerprint, and
    that node with each other one of its fingerprint. Nodes without words have no others."""
    own = materialize(nodes.filter("size(buckets) > 0").select("node", "fp"), "fingerprints")
    least = materialize(own.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    equal = spread_join(own, least, "fp", "first", "n", own.count()).filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, other = least.select(F.col("fp").alias("a"), F.col("first").alias("x")), least.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    near = links(least.select("fp")).distinct().join(one, "a").join(other, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.unionByName(near).distinct()


def linked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, of the nodes that a similar one was found for.
    nodes: node, least (one of its rows), buckets and fp.

    The components are those of all similar pairs that share a bucket or that `fingerprint_pairs` gives. They are computed anew only
    after a round that found new pairs, over the roots that those pairs join."""
    every = nodes.select("node", F.explode("buckets").alias("bucket"))
    crowded = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(every.join(crowded, "bucket"), "shared")
    company = materialize(shared.groupBy("node").agg(F.sum("n").alias("company")), "company")
    close = materialize(fingerprint_pairs(nodes), "close")
    wanted = company.select("node").union(close.select("a")).union(close.select("b")).distinct()
    sets = materialize(sets_of(rows, nodes.join(wanted, "node").select("node", "least")), "shingles")  # texts move once
    own = shared.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("own"))  # at most BANDS
    seen = company.join(own, "node").join(looks(sets), "node").select("node", "company", F.struct("sketch", "size", F.col("own").alias("buckets")).alias("look"))
    left = materialize(shared.join(seen, "node").select("bucket", "node", "look", "company", F.col("node").alias("root")), "buckets")
    roots = rows.sparkSession.createDataFrame([], "node long, root long")
    first, pivots = Window.partitionBy("bucket").orderBy(F.desc("company"), "node"), PIVOTS
    while True:
        apart = left.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
        old, left = left, materialize(left.join(apart, "bucket", "left_semi"), "buckets")
        release(old)
        if close is None and left.isEmpty():
            return roots
        top = left.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= pivots)
        chosen = materialize(top.groupBy("bucket").agg(F.collect_list(F.struct(F.col("node").alias("pivot"), F.col("root").alias("own"), "look")).alias("pivots")), "pivots")  # at most `pivots` each
        # a row of a bucket meets the bucket's one row of pivots, and goes on with those that it may be like
        # in the first of the buckets that both are in: a pair is one row, however many buckets it shares
        here = lambda p: F.array_min(F.array_intersect(F.col("look")["buckets"], p["look"]["buckets"])) == F.col("bucket")
        like = F.filter("pivots", lambda p: (p["own"] != F.col("root")) & plausible(F.col("look"), p["look"]) & here(p))
        met = left.join(chosen, "bucket").select("node", "root", F.explode(F.transform(like, lambda p: F.struct(p["pivot"].alias("pivot"), p["own"].alias("own")))).alias("p")).select("node", "root", "p.*")
        pairs = materialize(met.groupBy(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).agg(F.first(F.least("root", "own")).alias("__r"), F.first(F.greatest("root", "own")).alias("__s")), "pairs")
        if close is not None:  # in the first round every node is its own root
            pairs, close = materialize(pairs.unionByName(close.select("a", "b", F.col("a").alias("__r"), F.col("b").alias("__s"))).distinct(), "pairs"), None
        done = chosen.select(F.col("bucket").alias("__bucket"), F.explode("pivots.pivot").alias("pivot"))
        left = left.join(done, (F.col("bucket") == F.col("__bucket")) & (F.col("node") == F.col("pivot")), "left_anti")
        if not pairs.isEmpty():
            more = materialize(confirmed(pairs, sets), "edges")
            if not more.isEmpty():
                joined = components(more.select(F.col("__r").alias("a"), F.col("__s").alias("b"))).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
                # a root that was joined to a smaller one takes its nodes along; a node first linked now has its own
                known = roots.unionByName(joined.join(roots, F.col("__node") == F.col("node"), "left_anti").select(F.col("__node").alias("node"), F.col("__node").alias("root")))
                roots = materialize(known.join(joined, F.col("root") == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root")), "roots")
                renamed = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
                left = left.join(renamed, F.col("node") == F.col("__node"), "left").select("bucket", "node", "look", "company", F.coalesce("__root", "root").alias("root"))
        left = materialize(left, "buckets")
        pivots *= MORE


def admit(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of similar texts, chosen as in `simhash.admit`."""
    rows = identified(docs)
    prints = materialize(signatures(rows), "signatures")
    nodes = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("buckets").alias("buckets"), F.min("fp").alias("fp")), "nodes")
    roots = linked(rows, nodes).withColumnRenamed("node", "__node")
    best = nodes.join(roots, F.col("node") == F.col("__node"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("best"))
    return first_rows(docs, best)
