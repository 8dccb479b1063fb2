"""Operator 7: nearest neighbours by one navigable small-world graph a shard, results merged.

1. Equal vectors become one node that keeps its 11 smallest ids - all that a result of 10 without
   the query's own row can need - so a vector with very many copies is one node.
2. A hash of the vector deals nodes into shards of about `SHARD` nodes, so a shard's size is bounded
   whatever the table's. Each shard's hierarchical graph is built in one task and written as flat
   arrays: neighbours of the ground layer (nodes x 2M) and of each upper layer (nodes x M), -1 for none.
   A new node's candidates are found by walking the graph that there is, many nodes side by side.
3. Queries are dealt into blocks; each block meets each shard once and walks its graph with `EF` open nodes.
4. Shard results merge by exact distance (double precision), ties to the smaller id.

Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with a
null id. Only vectors of one length compare. Rows equal in id and vector count once. Empty tables give an
empty result; columns other than vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, ship

SHARD, BLOCK = 16_384, 4096
LINKS, EF_BUILD, EF = 16, 64, 128
#: Nodes that are inserted, and queries that walk, side by side.
BATCH = 256


def _distances(points: np.ndarray, q: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Squared distances of each q to the points of its row of `near`; infinite where that is -1."""
    gap = points[np.maximum(near, 0)]
    gap -= q[:, None, :]
    out = np.einsum("abd,abd->ab", gap, gap)
    out[near < 0] = np.inf
    return out


def _diverse(points: np.ndarray, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, by ascending distance, those nearer to the row's node than to any already
    taken; free places go to the nearest of the rest."""
    order = np.argsort(dist, 1, kind="stable")
    near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
    if near.shape[1] <= most:
        return near
    own = points[np.maximum(near, 0)]
    sq = np.einsum("abd,abd->ab", own, own)
    between = sq[:, :, None] + sq[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    closest, taken, held = np.full(dist.shape, np.inf, np.float32), np.zeros(dist.shape, bool), np.zeros(len(dist), int)
    for c in range(dist.shape[1]):
        hit = (near[:, c] >= 0) & (dist[:, c] < closest[:, c]) & (held < most)
        taken[:, c] = hit
        held += hit
        rows = np.flatnonzero(hit)
        closest[rows] = np.minimum(closest[rows], between[rows, c])
    rank = np.where(taken, 0, np.where(near >= 0, 1, 2)) * near.shape[1] + np.arange(near.shape[1])
    return np.take_along_axis(near, np.argsort(rank, 1)[:, :most], 1)


class Graph:
    """layers[l]: (nodes, links) neighbours, -1 for none; node 0.. in insertion order.

    Nodes are inserted in batches: each node of a batch walks the graph built so far, all side by side, and
    meets the others of its batch directly. So a node costs a walk, whatever the number of nodes."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry
        self.points = np.asarray(vectors, np.float32)

    @staticmethod
    def build(vectors: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 1) -> Graph:
        n = len(vectors)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(links)).astype(int), 6)
        graph = Graph(vectors, [np.full((n, links * (2 if i == 0 else 1)), -1, np.int32) for i in range(int(level.max(initial=0)) + 1)], 0)
        done, top = 0, -1
        while done < n:
            batch = np.arange(done, min(n, done + min(BATCH, max(32, done))))
            at = np.full(len(batch), graph.entry, np.int32)
            for l in range(len(graph.layers) - 1, -1, -1):
                own = level[batch] >= l
                found = np.full((len(batch), ef), -1, np.int32)
                if l <= top:
                    if not own.all():
                        at[~own] = graph.walk(graph.points[batch[~own]], at[~own], l, 1)[0][:, 0]
                    if own.any():
                        found[own] = graph.walk(graph.points[batch[own]], at[own], l, ef)[0]
                        at[own] = found[own, 0]
                if own.any():
                    graph._link(batch[own], found[own], l, links)
            done = int(batch[-1]) + 1
            if level[batch].max() > top:
                top = int(level[batch].max())
                graph.entry = int(batch[level[batch].argmax()])
        return graph

    def _link(self, batch: np.ndarray, found: np.ndarray, l: int, links: int) -> None:
        """Links of a batch's nodes on a layer, to what they found and to each other, and back."""
        table, points = self.layers[l], self.points
        most = table.shape[1]
        own = points[batch]
        sq = np.einsum("ab,ab->a", own, own)
        among = sq[:, None] + sq[None, :] - 2 * own @ own.T
        np.fill_diagonal(among, np.inf)
        k = min(len(batch) - 1, links)
        mates = np.argpartition(among, k, 1)[:, :k] if 0 < k < len(batch) - 1 else np.argsort(among, 1)[:, :k]
        near = np.concatenate([found, batch[mates].astype(np.int32)], 1)
        chosen = _diverse(points, near, _distances(points, own, near), links)
        table[batch, : chosen.shape[1]] = chosen
        # and back: each chosen node may take the new one in
        to, new = chosen.ravel(), np.repeat(batch, chosen.shape[1]).astype(np.int32)
        keep = to >= 0
        to, new = to[keep], new[keep]
        keep = ~(table[to] == new[:, None]).any(1)
        to, new = to[keep], new[keep]
        if not len(to):
            return
        gap = points[to] - points[new]
        order = np.lexsort((np.einsum("ab,ab->a", gap, gap), to))
        to, new = to[order], new[order]
        nodes, first, sizes = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, sizes)
        some = place < most  # a row holds no more, and the nearest come first
        wide = np.full((len(nodes), int(place[some].max()) + 1), -1, np.int32)
        wide[np.repeat(np.arange(len(nodes)), sizes)[some], place[some]] = new[some]
        for i in range(0, len(nodes), 512):
            rows = nodes[i : i + 512]
            near = np.concatenate([table[rows], wide[i : i + 512]], 1)
            table[rows] = _diverse(points, near, _distances(points, points[rows], near), most)[:, :most]

    def walk(self, q: np.ndarray, at: np.ndarray, l: int, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each q the about `ef` nearest nodes of a layer, nearest first, and their squared distances: the
        nearest open nodes, `wide` at a time, are opened until none of those held is open."""
        table, points = self.layers[l], self.points
        rows, wide = np.arange(len(q)), min(wide, ef)
        held, dist = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), np.inf, np.float32)
        held[:, 0], dist[:, 0] = at, _distances(points, q, at[:, None].astype(np.int32))[:, 0]
        open_ = held >= 0
        seen = np.zeros((len(q), len(points)), bool)
        seen[rows, at] = True
        while True:
            waiting = np.where(open_, dist, np.inf)
            go = np.flatnonzero(open_.any(1))
            if not len(go):
                return held, dist
            nearest = np.argpartition(waiting[go], wide - 1, 1)[:, :wide] if wide < ef else np.broadcast_to(np.arange(ef), (len(go), ef))
            from_ = np.where(np.take_along_axis(open_[go], nearest, 1), np.take_along_axis(held[go], nearest, 1), -1)
            open_[go[:, None], nearest] = False
            near = np.where(from_[:, :, None] >= 0, table[np.maximum(from_, 0)], -1).reshape(len(go), -1)
            near[seen[go[:, None], np.maximum(near, 0)]] = -1
            near.sort(1)  # the same node may come from two of them
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            x, y = np.nonzero(near >= 0)
            seen[go[x], near[x, y]] = True
            both_d = np.concatenate([dist[go], _distances(points, q[go], near)], 1)
            both, fresh = np.concatenate([held[go], near], 1), np.concatenate([open_[go], near >= 0], 1)
            best = np.argsort(both_d, 1, kind="stable")[:, :ef]
            dist[go], held[go], open_[go] = (np.take_along_axis(z, best, 1) for z in (both_d, both, fresh))

    def search(self, q: np.ndarray, k: int, ef: int = EF) -> np.ndarray:
        """About the k nearest nodes of each q, nearest first, -1 for none."""
        q, out = np.asarray(q, np.float32), []
        for i in range(0, len(q), BATCH):
            own = q[i : i + BATCH]
            at = np.full(len(own), self.entry, np.int32)
            for l in range(len(self.layers) - 1, 0, -1):
                at = self.walk(own, at, l, 1)[0][:, 0]
            out.append(self.walk(own, at, 0, max(ef, k))[0][:, :k])
        return np.concatenate(out)


def usable(df: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def build_index(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The written index, one row a shard, and the number of shards. rows: vec_id, v."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = rows.distinct().withColumn("__rank", rank).filter(F.col("__rank") <= k + 1)
    nodes = materialize(kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = max(1, math.ceil(nodes.count() / SHARD))
    # the length is part of the shard's key: vectors of unlike length never meet
    keyed = nodes.withColumns({"dims": F.size("v"), "shard": F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"), "place": F.xxhash64("ids")})

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table["place"].to_numpy(), kind="stable")
        table = table.combine_chunks().take(pa.array(order))
        dims = table["dims"][0].as_py()
        vectors = np.array(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
        ids = table["ids"].combine_chunks()
        graph = Graph.build(vectors)
        return pa.table({
            "dims": pa.array([dims], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
            "ids": pa.array([np.asarray(ids.flatten()).astype("<i8").tobytes()], pa.binary()), "counts": pa.array([np.asarray(ids.value_lengths()).astype("<i4").tobytes()], pa.binary()),
            "layers": pa.array([[x.astype("<i4").tobytes() for x in graph.layers]], pa.list_(pa.binary())), "shape": pa.array([json.dumps([x.shape for x in graph.layers])], pa.string()), "entry": pa.array([graph.entry], pa.int32()),
        })

    index = keyed.groupBy("dims", "shard").applyInArrow(build, "dims int, shard int, vectors binary, ids binary, counts binary, layers array<binary>, shape string, entry int")
    return materialize(index, "graphs"), shards


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. rows and queries: vec_id, v as `usable` gives them."""
    ship(rows.sparkSession)
    index, shards = build_index(rows, k)
    asked = queries.distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dims"))
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def walk(graphs: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if graphs.num_rows and block.num_rows:
            g = graphs.slice(0, 1).to_pylist()[0]
            vectors = np.frombuffer(g["vectors"], "<f8").reshape(-1, g["dims"])
            layers = [np.frombuffer(x, "<i4").reshape(s) for x, s in zip(g["layers"], json.loads(g["shape"]))]
            graph, ids = Graph(vectors, layers, g["entry"]), np.frombuffer(g["ids"], "<i8")
            ends = np.cumsum(np.frombuffer(g["counts"], "<i4"))
            counts = np.diff(ends, prepend=0)
            asks = np.array(block["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(block.num_rows, -1)
            for own, q, nodes in zip(block["query_id"].to_pylist(), asks, graph.search(asks, k + 1).tolist()):
                found = []
                for node in nodes:
                    if node < 0:
                        break
                    score = math.sqrt(float(((vectors[node] - q) ** 2).sum()))
                    found += [(score, i) for i in ids[ends[node] - counts[node] : ends[node]].tolist() if i != own]
                out += [(own, i, score) for score, i in sorted(found)[:k]]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    keys = ("dims", "shard", "block")
    found = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(walk, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
