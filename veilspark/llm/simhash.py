"""Operator 4: near duplicates by SimHash, compared exactly in tiles.

1. Each text's fingerprint is computed in one pass (`fingerprints`) and written, a few bytes a row.
2. Equal fingerprints are one node from here on, however many rows hold them.
3. A fingerprint's tile is its vector of population counts, one for each of `BLOCKS` equal parts.
   Flipping one bit changes one count by one, so tiles whose vectors differ by more than the radius
   (in sum) can't hold a link and are never paired. Each node visits the neighbouring tiles on one
   side; a tile's own nodes are held while its visitors stream by in batches, and numpy's
   exclusive-or and bit count compare them all, exactly, with no cap.
4. A tile passes on a spanning forest of the links that it finds, never all pairs.
5. Components of the forest edges: large-star and small-star steps, each written to the shared
   folder, until nothing changes.

Null texts and texts without words have fingerprint zero and link as any other. Rows with a null id
take part; a component's id is its smallest id that isn't null (null if all are). Repeated rows stay. An
empty table gives an empty result; columns that clash with the output's are left out. Very long texts
are hashed whole, one at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, partitions, release, ship, spread_join, strings, whole_text

SHINGLE, SEED, RADIUS = 3, 42, 2
BLOCKS = 4
#: Nodes of a chunk of a tile, and of a slice of its visitors: a task compares one chunk with one slice.
HOME, VISIT = 20_000, 400_000
_LAST = (1 << 63) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in strings(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    out = docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, out)


def offsets(radius: int, blocks: int = BLOCKS) -> list[int]:
    """Differences of packed vectors (a byte a block) to neighbouring tiles, one of each opposite pair."""
    out = []
    for d in itertools.product(range(-radius, radius + 1), repeat=blocks):
        if 0 < sum(map(abs, d)) <= radius and next(x for x in d if x) > 0:
            out.append(sum(x << 8 * i for i, x in enumerate(d)))
    return sorted(out)


class Forest:
    """Union by smallest label over the nodes of one tile, kept by position."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.parent = nodes, np.arange(len(nodes))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """Unite each pair of positions; the pairs that united something are the forest's edges."""
        while len(a):
            root = self._roots()
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if not len(a):
                return
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(high, return_index=True)  # one link a root and round: no circle, since it always falls
            self.parent[high[first]] = low[first]
            yield from zip(a[first].tolist(), b[first].tolist())

    def _roots(self) -> np.ndarray:
        root = self.parent
        while not np.array_equal(up := root[root], root):
            root = up
        self.parent = root.copy()
        return root


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius, tile by tile."""
    for i in range(0, len(a), 256):
        for j in range(0, len(b), 4096):
            near = np.bitwise_count(a[i : i + 256, None] ^ b[None, j : j + 4096]) <= radius
            if near.any():
                x, y = np.nonzero(near)
                yield x + i, y + j


def _tile_edges(home: np.ndarray, visitors: Iterator[np.ndarray], radius: int, among: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forest edges of one chunk: among its own nodes (if `among`), then with each batch of visitors. A visitor's
    first link is an edge; its further ones unite the nodes at home."""
    forest = Forest(home)
    for x, y in _close(home, home, radius) if among else ():
        up = x < y
        if edges := list(forest.join(x[up], y[up])):
            p, q = np.array(edges).T
            yield home[p], home[q]
    for batch in visitors:
        seen = np.full(len(batch), -1)
        for x, y in _close(home, batch, radius):
            who, first = np.unique(y, return_index=True)
            new = seen[who] < 0
            seen[who[new]] = x[first[new]]
            yield batch[who[new]], home[x[first[new]]]
            if edges := list(forest.join(x, seen[y])):
                p, q = np.array(edges).T
                yield home[p], home[q]


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, home_rows: int = HOME, visit_rows: int = VISIT) -> DataFrame:
    """a, b: forest edges of the links among distinct fingerprints `fp`.

    A tile's own nodes are cut into chunks of about `home_rows` and its visitors into slices of about
    `visit_rows`, and each chunk meets each slice (and each chunk before it) in a task of its own, so
    no task grows with the fullest tile."""
    ship(nodes.sparkSession)
    width = 64 // blocks
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))) for i in range(blocks)]
    # a byte a block, from 8 on: no borrow between bytes
    own = nodes.select("fp", sum(((c.cast("long") + 8) * (1 << 8 * i) for i, c in enumerate(counts)), F.lit(0).cast("long")).alias("tile"))
    moves = F.explode(F.array(*[F.lit(x).cast("long") for x in offsets(radius, blocks)])).alias("move")
    homes = materialize(own.groupBy("tile").agg(F.count(F.lit(1)).alias("n")), "tiles")  # at most (64 / blocks + 1) ^ blocks rows
    met = homes.select("tile", "n", moves).select((F.col("tile") + F.col("move")).alias("tile"), "n").groupBy("tile").agg(F.sum("n").alias("visitors"))
    stats = homes.join(met, "tile", "left").select(
        "tile", F.ceil(F.col("n") / home_rows).cast("int").alias("chunks"), F.greatest(F.lit(1), F.ceil((F.coalesce("visitors", F.lit(0)) + F.col("n")) / visit_rows)).cast("int").alias("slices")
    )
    stats = F.broadcast(stats) if blocks <= 4 else stats
    chunk, part = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("slices")).cast("int")
    at_home = own.join(stats, "tile")
    stay = at_home.select("tile", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"), F.lit(False).alias("visits"), "fp")
    later = at_home.filter(chunk < F.col("chunks") - 1).select("tile", F.explode(F.sequence(chunk + 1, F.col("chunks") - 1)).alias("chunk"), part.alias("part"), F.lit(True).alias("visits"), "fp")
    away = own.select("fp", "tile", moves).select((F.col("tile") + F.col("move")).alias("tile"), "fp").join(stats, "tile")
    visit = away.select("tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), part.alias("part"), F.lit(True).alias("visits"), "fp")
    key = ["tile", "chunk", "part"]
    dealt = stay.unionByName(later).unionByName(visit).repartition(partitions(nodes.sparkSession), *key).sortWithinPartitions(*key, "visits")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], bool, np.ndarray]]:
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*key, "visits")]
            fp = batch.column("fp").to_numpy().view(np.uint64)
            changes = np.zeros(max(0, len(fp) - 1), bool)
            for c in columns:
                changes |= c[1:] != c[:-1]
            for i, j in itertools.pairwise([0, *(np.flatnonzero(changes) + 1).tolist(), len(fp)]):
                if i < j:
                    yield tuple(int(c[i]) for c in columns[:3]), bool(columns[3][i]), fp[i:j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, group in itertools.groupby(runs(batches), key=lambda r: r[0]):
            home: list[np.ndarray] = []
            first = None
            for r in group:
                if r[1]:
                    first = r
                    break
                home.append(r[2])
            if not home:
                continue
            visitors = (r[2] for r in itertools.chain([first] if first else [], group))
            for a, b in _tile_edges(np.concatenate(home), visitors, radius, task[2] == 0):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for each node of `edges` (a, b).

    Each round halves the depth at least; its edges - never more than nodes and forest edges - are
    written, so a lost executor costs one round at most, and those of the round before are removed.
    The centre of a large star is one key of many rows: `spread_join` splits it."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = materialize(edges, "edges"), None
    total = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = spread_join(both.filter("v > u"), least, "u", "m", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        pair = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = spread_join(large, low, "u", "m", "n", 2 * total).select(F.explode(pair).alias("e")).select("e.*").filter("u <> v").distinct()
        old, edges = edges, materialize(small, "edges")
        release(old)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, total = state, max(1, state[0])


def group(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each document."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    roots = components(links(nodes.select("fp"), radius, blocks))
    rooted = materialize(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    # a component's rows may be many nodes, and a node's many documents: both joins split such keys
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    named = spread_join(rooted, ids, "root", "component_id", "nodes", total).select("fp", "component_id", "n")
    out = spread_join(prints, named, "fp", "component_id", "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def identified(docs: DataFrame) -> DataFrame:
    """text and, as doc_id, the struct of id (nulls last) and hash of the text by which rows are told apart."""
    return docs.select("text", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(whole_text()).alias("h")).alias("doc_id"))


def first_rows(docs: DataFrame, best: DataFrame) -> DataFrame:
    """One row of docs for each `best`, a struct as of `identified`."""
    best = best.select(F.col("best.id").alias("__kept"), F.col("best.h").alias("__kept_hash"))
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__id"), F.xxhash64(whole_text()).alias("__hash"))
    kept = keyed.join(best, (F.col("__id") == F.col("__kept")) & (F.col("__hash") == F.col("__kept_hash")), "left_semi")
    once = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.lit(0)))  # the row itself may be repeated
    return kept.withColumn("__nth", once).filter("__nth = 1").select("__row.*")


def admit(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (nulls last), then of the
    smallest hash of the text. Only ids, hashes and fingerprints are grouped, never texts."""
    prints = materialize(fingerprints(identified(docs), shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    best = nodes.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("best"))
    return first_rows(docs, best)
