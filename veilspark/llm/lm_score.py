"""Operator 6: scores by cross-entropy difference between two matched n-gram models.

The target model is counted over documents whose labels are all of quality 1 and none toxic, the
background model over all documents. Both are interpolated bigram models over one vocabulary: all
lower-cased words. Words and pairs of neighbouring words are told apart by hashes of 64 bits and
their counts are kept for each, however many there are. Both models have the same words, weights and
smoothing: `FLAT` for each word of the vocabulary, which counts as `WORDS` words at least.

Each document is scored by models without itself (leave one out): its own counts are taken off the
background's, and off the target's where it is part of that. So nothing is scored by what it taught,
and a document that occurs twice is known to the background by its copy.

1. Texts are written in compressed chunks of about `CHUNK` bytes. Ids alone meet the labels.
2. A worker sends each chunk's distinct words and pairs, as sorted keys with the counts of both models,
   in one packed row for each of a number of buckets of keys.
3. A bucket sums the counts of its keys and answers each chunk's row with the totals, in the row's
   order: a few bits a key. So neither the driver nor a worker holds the models.
4. A chunk's texts and answers meet, and the texts are scored.

A text's score is the mean over its tokens of target loss minus background loss, in bits: the lower,
the closer to the target.

Null text or no words: no tokens, all losses and the score 0. Null ids are in the background alone.
Without labels the target model is uniform. Repeated rows count and are scored each, without one of
them. An empty table gives an empty result; columns that clash with the output's are left out. A very
long text is a chunk of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, partitions, portions, ship, slices, strings, whole_text

WORDS, CHUNK = 1 << 18, 4_000_000
BIGRAM_SHARE, FLAT = 0.5, 0.5
#: Keys that a bucket should hold at most, counted once for each chunk that has them.
BUCKET_KEYS = 2_000_000
#: Characters of distinct words in a worker's memo beyond which it starts anew (memory only).
MEMO = 2_000_000
_MEMO: dict[bytes, int] = {}
_HELD = [0]
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of each text."""
    if _HELD[0] > MEMO:
        _MEMO.clear()
        _HELD[0] = 0
    split = [t.lower().encode().split() for t in texts]
    flat = [w for ws in split for w in ws]
    for w in set(flat).difference(_MEMO):
        _MEMO[w] = xxhash.xxh64_intdigest(w)
        _HELD[0] += len(w)
    return np.fromiter(map(_MEMO.__getitem__, flat), np.uint64, len(flat)).view(np.int64), np.fromiter(map(len, split), np.int64, len(split))


def pairs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each word with the one before it (at a text's start: with none)."""
    before = np.concatenate([[0], words[:-1]]) if len(words) else words.copy()
    before[first] = 0
    mixed = (before.astype(np.uint64) * _ONE) ^ (words.astype(np.uint64) * _TWO + np.uint64(1))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(times)
    return mixed.view(np.int64)


def _first(counts: np.ndarray) -> np.ndarray:
    return (np.cumsum(counts) - counts)[counts > 0]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, each key's place among them, and how often each occurs."""
    own, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return own, at.astype(np.int32), n.astype(np.uint32)


class Grams:
    """The words and pairs of a chunk's texts: distinct keys, and each token's places among them."""

    def __init__(self, texts: list[str]):
        found = [tokens(texts[a:b]) for a, b in slices(texts)]
        words = np.concatenate([np.empty(0, np.int64), *(w for w, _ in found)])
        self.lengths = np.concatenate([np.empty(0, np.int64), *(n for _, n in found)])
        self.first = _first(self.lengths)
        self.inner = np.ones(len(words), bool)
        self.inner[self.first] = False  # first words follow none: they stand alone
        self.words, self.word_at, self.word_counts = distinct(words.view(np.uint64))
        self.pairs, self.pair_at, self.pair_counts = distinct(pairs(words, self.first).view(np.uint64)[self.inner])
        self.text_at = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def own(self, at: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        """For each token, how often its text holds its key (at: places of keys, of: texts)."""
        keyed = of.astype(np.int64) * size + at
        order = np.argsort(keyed, kind="stable")
        new = np.concatenate([[True], np.diff(keyed[order]) != 0]) if len(order) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        out = np.empty(len(order), np.int64)
        out[order] = np.bincount(group, minlength=1)[group] if len(order) else 0
        return out


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers, their number first, compressed with byte planes apart: planes of zeros all but vanish."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def requests(keys: np.ndarray, counts: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """bucket, keys (as steps from one to the next) and each of the counts, bucket by bucket.

    A bucket is an equal range of keys, so a sorted array is cut, never sorted again."""
    width = (1 << 64) // buckets + 1
    cuts = np.searchsorted(keys, np.array([b * width for b in range(1, buckets)], np.uint64))
    for b, (i, j) in enumerate(itertools.pairwise([0, *cuts.tolist(), len(keys)])):
        if i < j:
            yield b, packed(np.diff(keys[i:j], prepend=np.uint64(0))), *(packed(c[i:j].astype(np.uint32)) for c in counts)


CHUNKS = "chunk long, ids array<long>, sizes array<int>, texts binary"


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of CHUNKS, written: the ids of some documents, their texts' bytes, and all texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, held, letters = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            sizes = list(map(len, held))
            texts = pa.compress(b"".join(held), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([texts], pa.binary())], names=["chunk", "ids", "sizes", "texts"])

        for batch in portions(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text")):
                raw = text.encode()
                if held and letters + len(raw) > size:
                    yield row()
                    chunk, ids, held, letters = chunk + 1, [], [], 0
                ids.append(doc_id)
                held.append(raw)
                letters += len(raw)
        if held:
            yield row()

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, CHUNKS), "chunks")


def texts_of(row: dict) -> list[str]:
    raw = pa.decompress(row["texts"], sum(row["sizes"]), codec="zstd", asbytes=True)
    ends = list(itertools.accumulate(row["sizes"], initial=0))
    return [raw[i:j].decode() for i, j in itertools.pairwise(ends)]


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0").select("id")


def targets(chunked: DataFrame, labels: DataFrame) -> DataFrame:
    """chunk and target, the ids of its documents that are of the target (a row for each chunk). Ids
    alone meet the labels, by a merge join at every size."""
    found = chunked.select("chunk", F.explode("ids").alias("id")).distinct().join(good_ids(labels).hint("merge"), "id").groupBy("chunk").agg(F.collect_list("id").alias("target"))
    return materialize(found, "target")


ASKED = "chunk long, word boolean, bucket int, keys binary, background binary, target binary"


def asked(flagged: DataFrame, buckets: int) -> DataFrame:
    """ASKED rows of CHUNKS rows with `target`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            row = batch.to_pylist()[0]
            grams = Grams(texts_of(row))
            mine = is_target(row["ids"], row["target"])[grams.text_at]
            for word, keys, counts, at, of in ((True, grams.words, grams.word_counts, grams.word_at, mine), (False, grams.pairs, grams.pair_counts, grams.pair_at, mine[grams.inner])):
                if len(keys):
                    own = list(zip(*requests(keys, [counts, np.bincount(at[of], minlength=len(keys))], buckets)))
                    same = [pa.array([x] * len(own[0]), t) for x, t in ((row["chunk"], pa.int64()), (word, pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(own[0], pa.int32()), *(pa.array(c, pa.binary()) for c in own[1:])], names=["chunk", "word", "bucket", "keys", "background", "target"])

    return flagged.mapInArrow(run, ASKED)


def is_target(ids: list[int | None], target: list[int] | None) -> np.ndarray:
    chosen = set(target or ())
    return np.array([i in chosen for i in ids], bool)


TOLD = "chunk long, word boolean, bucket int, target binary, background binary, distinct long, target_total long, background_total long"
_TOLD = pa.schema([("chunk", pa.int64()), ("word", pa.bool_()), ("bucket", pa.int32()), ("target", pa.binary()), ("background", pa.binary()), ("distinct", pa.int64()), ("target_total", pa.int64()), ("background_total", pa.int64())])


def told(rows: DataFrame) -> DataFrame:
    """The answers to ASKED rows: totals in each row's order. One row a bucket, of chunk null, holds
    the bucket's number of distinct words and their sums."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        out: list[dict] = []
        for word in (True, False):
            some = table.filter(pa.array([w == word for w in table["word"].to_pylist()]))
            if not some.num_rows:
                continue
            each = [np.cumsum(unpacked(k.as_py(), np.uint64), dtype=np.uint64) for k in some["keys"]]
            sizes = list(map(len, each))
            keys, back, _ = distinct(np.concatenate(each))
            n_keys = len(keys)
            del each, keys
            sums = {}
            for model in ("target", "background"):
                sums[model] = np.bincount(back, np.concatenate([unpacked(c.as_py(), np.uint32) for c in some[model]]), n_keys).astype(np.uint64)
            at = 0
            for chunk, n in zip(some["chunk"].to_pylist(), sizes):
                own = back[at : at + n]
                at += n
                out.append({"chunk": chunk, "word": word, "bucket": bucket, **{m: packed(sums[m][own]) for m in sums}, "distinct": 0, "target_total": 0, "background_total": 0})
            if word:
                out.append({"chunk": None, "word": True, "bucket": bucket, "target": b"", "background": b"", "distinct": n_keys, "target_total": int(sums["target"].sum()), "background_total": int(sums["background"].sum())})
        return pa.Table.from_pylist(out, _TOLD)

    return rows.groupBy("bucket").applyInArrow(run, TOLD)


def losses(words: np.ndarray, before: np.ndarray, both: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """Bits for each token under one model: counts of its word, of the word before it and of the pair
    (both 0 for first words), and of all words."""
    alone = (words + FLAT) / (total + FLAT * vocabulary)
    share = np.divide(both, before, out=np.zeros(len(both)), where=before > 0)
    return -np.log2(np.where(before > 0, BIGRAM_SHARE * share + (1 - BIGRAM_SHARE) * alone, alone))


def score(docs: DataFrame, labels: DataFrame, size: int = CHUNK, leave_out: bool = True) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (bits a token) and score of each document.
    leave_out: whether models leave out the document that they score."""
    spark = docs.sparkSession
    ship(spark)
    chunked = chunks(docs, size)
    chosen = targets(chunked, labels)
    flagged = chunked.join(chosen.hint("merge"), "chunk", "left")
    letters = chunked.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    buckets = max(partitions(spark), math.ceil(letters / 4 / BUCKET_KEYS))  # about a word and a pair each six characters
    answers = materialize(told(asked(flagged, buckets)), "answers")
    of = answers.filter("chunk is null").agg(F.sum("distinct").alias("words"), F.sum("target_total").alias("target"), F.sum("background_total").alias("background")).first()
    totals, vocabulary = (float(of["target"] or 0), float(of["background"] or 0)), max(WORDS, of["words"] or 0)
    shared = answers.filter("chunk is not null").select("chunk", "word", "bucket", "target", "background")
    # the ids of the target travel with the answers
    shared = shared.unionByName(chosen.select("chunk", F.col("target").alias("ids")), allowMissingColumns=True)

    def run(texts: pa.Table, given: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("target_loss", "background_loss", "score")}})
        row = texts.to_pylist()[0]
        grams = Grams(texts_of(row))
        words, where = given["word"].to_pylist(), given["bucket"].to_pylist()
        target = is_target(row["ids"], next((x for x, w in zip(given["ids"].to_pylist(), words) if w is None), None))
        counts: dict[tuple[bool, str], np.ndarray] = {}
        for word in (True, False):
            rows = sorted((where[i], i) for i, w in enumerate(words) if w is word)
            for model in ("target", "background"):
                counts[word, model] = np.concatenate([np.empty(0, np.uint64), *(unpacked(given[model][i].as_py(), np.uint64) for _, i in rows)]).astype(np.int64)
        word_own = grams.own(grams.word_at, grams.text_at, len(grams.words))
        pair_own = np.zeros(len(grams.inner), np.int64)
        pair_own[grams.inner] = grams.own(grams.pair_at, grams.text_at[grams.inner], len(grams.pairs))
        out = []
        for model, total, inside in (("target", totals[0], target & leave_out), ("background", totals[1], np.full(len(target), leave_out))):
            mine = inside[grams.text_at]
            alone = counts[True, model][grams.word_at] - word_own * mine
            before = np.where(grams.inner, np.concatenate([[0], alone[:-1]]) if len(alone) else alone, 0)
            both = np.zeros(len(alone), np.int64)
            both[grams.inner] = counts[False, model][grams.pair_at]
            both -= pair_own * mine
            sums = np.zeros(len(grams.lengths))
            if len(alone):
                sums[grams.lengths > 0] = np.add.reduceat(losses(alone, before, both, (total - grams.lengths * inside)[grams.text_at], vocabulary), grams.first)
            out.append(sums / np.maximum(grams.lengths, 1))
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": grams.lengths, "target_loss": out[0], "background_loss": out[1], "score": out[0] - out[1]})

    return chunked.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
