"""Operator 10: packing by optimal length buckets.

Texts are encoded and counted; a text longer than the context is laid out as consecutive pieces
of at most `CONTEXT` tokens, so every token is packed. Over the global histogram of piece lengths
(at most CONTEXT entries, whatever the corpus) dynamic programming chooses the `BUCKETS` boundaries
that minimise padding. In each bucket, pieces form batches of as many rows, padded to the boundary,
as the token budget holds.

Pieces are numbered within their bucket by per-partition counts and their sums, so no bucket - one
may hold nearly all rows - meets in one task. Lengths are written once, a few bytes a row.

Null or empty text: one piece of length 0, in the smallest bucket. Order within a bucket: length,
doc_id (nulls first), then piece and hash of the text; repeated rows stay, each in its own place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .sharding import ordered_rows
from .shared import materialize, portions, ship, slices, strings, whole_text

CONTEXT, BUCKETS, BUDGET = 2048, 16, 65_536


def id_type(spec: str) -> str:
    return "<u2" if bpe.model_of(spec).size <= 1 << 16 else "<u4"


PIECES = "doc_id long, text_hash long, piece long, n_tokens long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, context: int = CONTEXT) -> DataFrame:
    """Rows of PIECES: the encoding of each text, cut at each `context` tokens. ids are unsigned
    little-endian numbers of two bytes, or of four where the vocabulary needs them."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(bpe.read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = bpe.speculative_encoder(spec.value), np.dtype(id_type(spec.value))
        for batch in portions(batches):
            texts = strings(batch, "text")
            for a, b in slices(texts):
                flat, counts = encoder.encode(texts[a:b])
                each = np.maximum(1, -(-counts // context))
                row = np.repeat(np.arange(b - a), each)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                size = np.minimum(context, counts[row] - piece * context)  # pieces follow each other in flat
                ends = np.concatenate([[0], np.cumsum(size) * kind.itemsize]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype(kind))])
                own = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("text_hash").take(own), pa.array(piece), pa.array(size), packed], names=["doc_id", "text_hash", "piece", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text")).mapInArrow(run, PIECES)


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The upper bounds, ascending, of at most `buckets` buckets with the least padding.

    best[k][j]: least padded total of the j smallest distinct lengths in k buckets. A bucket over
    lengths i..j costs bound(j) * rows(i..j); each row of the table is one vectorised minimum for
    each j, L^2 steps a bucket over at most CONTEXT + 1 lengths."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    rows = np.concatenate([[0], np.cumsum([histogram[int(s)] for s in sizes])])
    best = np.where(np.arange(len(sizes) + 1) == 0, 0, np.iinfo(np.int64).max // 4)
    back = []
    for _ in range(min(buckets, len(sizes))):
        nxt, cut = best.copy(), np.arange(len(sizes) + 1)
        for j in range(1, len(sizes) + 1):
            total = best[:j] + sizes[j - 1] * (rows[j] - rows[:j])
            i = int(total.argmin())
            if total[i] < nxt[j]:
                nxt[j], cut[j] = total[i], i
        best = nxt
        back.append(cut)
    out, j = [], len(sizes)
    for cut in reversed(back):
        if cut[j] != j:
            out.append(int(sizes[j - 1]))
            j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, tokenizer: str, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, text_hash, piece, n_tokens, bucket (its boundary), batch and slot (from 0 within bucket
    and batch), padding and ids of each piece, in files where a batch's pieces follow each other."""
    written = materialize(pieces(docs, tokenizer, context), "pieces")  # dealing by range reads its input twice; texts are encoded once
    rows = ordered_rows(written, ["n_tokens", "doc_id", "piece", "text_hash"], "packing")
    histogram = {r["n_tokens"]: r["n"] for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most context + 1 rows
    bounds = boundaries(histogram, buckets)
    bucket = F.lit(bounds[-1] if bounds else 0)
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket.cast("long"))
    # rows are sorted by length, so a bucket's rows in a partition are consecutive: its first place and count say all
    first = rows.groupBy("bucket", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = first.select(F.col("bucket").alias("__bucket"), F.col("part").alias("__part"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("__shift"))
    placed = rows.join(F.broadcast(base), (F.col("bucket") == F.col("__bucket")) & (F.col("part") == F.col("__part"))).withColumn("__i", F.col("place") + F.col("__shift"))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket")))).cast("long")
    return placed.withColumn("__each", each).select(
        "doc_id", "text_hash", "piece", "n_tokens", "bucket", F.expr("__i div __each").alias("batch"), (F.col("__i") % F.col("__each")).alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"), "ids"
    )


def unpacked(packed: DataFrame, tokenizer: str, pad: int | None = None) -> DataFrame:
    """packed with ids as array<int>; with `pad`, also filled up to the boundary, and `mask`, 1 for each
    token and 0 for padding."""
    ship(packed.sparkSession)
    kind = np.dtype(id_type(bpe.read_spec(tokenizer)))
    schema = packed.withColumn("ids", F.lit(None).cast("array<int>")).schema
    if pad is not None:
        schema = schema.add("mask", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            columns = {name: batch.column(name) for name in batch.schema.names}
            if pad is not None:
                fill = batch.column("padding").to_pylist()
                columns["mask"] = pa.array([np.repeat([1, 0], [len(r), n]) for r, n in zip(rows, fill)], pa.list_(pa.int32()))
                rows = [np.concatenate([r, np.full(n, pad)]) for r, n in zip(rows, fill)]
            columns["ids"] = pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([columns[name] for name in schema.names], names=schema.names)

    return packed.mapInArrow(run, schema)
