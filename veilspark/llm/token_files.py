"""Operator 9: token ids as Parquet files that serve selective reads.

One row for each document, in ascending doc_id order over files and rows: doc_id, n_tokens, where
the file's ids stood before it (`file_start`), the file's number, and the ids as a list column.
Ids fit a dictionary of the vocabulary's size, so they are stored as bit-packed dictionary codes;
the long columns use delta encoding (format version 2). Row groups and pages are small enough that
page indexes on doc_id let a reader fetch some documents' tokens, or the metadata alone.

A file is one range of doc_id: ids are encoded after the texts are dealt out by range and sorted, in
the task that writes them. Its rows' global start is its own running count plus the totals of the
files before it, which are read back from the two metadata columns.

Null text: only the end id. Null ids come first, equal ids by hash of their text; repeated rows stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import new_path, partitions, portions, ship, slices, strings, whole_text

END = 2
SCHEMA = "file int, doc_id long, n_tokens long, file_start long, ids array<int>"
#: Parquet writer settings: sizes in bytes.
FORMAT = {
    "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.column.index.truncate.length": "16", "compression": "zstd",
}


def encode(docs: DataFrame, tokenizer: str, end: int | None = END) -> DataFrame:
    """Rows of SCHEMA; `file` is the number of the range, ascending with doc_id."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(bpe.read_spec(tokenizer))
    keyed = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    # the range's bounds are sampled from the keys: a hash, never texts
    dealt = keyed.repartitionByRange(partitions(spark), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, part = bpe.speculative_encoder(spec.value), 0, TaskContext.get().partitionId()
        tail = [] if end is None else [end]
        for batch in portions(batches):
            texts = strings(batch, "text")
            for a, b in slices(texts):
                flat, counts = encoder.encode(texts[a:b])
                if tail:
                    flat, counts = np.insert(flat, np.cumsum(counts), end), counts + 1
                upto = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), batch.column("doc_id").slice(a, b - a), pa.array(counts), pa.array(start + upto - counts), lists], names=["file", "doc_id", "n_tokens", "file_start", "ids"])
                start += int(upto[-1])

    return dealt.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = END) -> None:
    encode(docs, tokenizer, end).write.options(**FORMAT).parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """The files' rows with `start`, the ids of all documents before. One row a file is gathered."""
    totals = files.groupBy(F.col("file").alias("__file")).agg(F.sum("n_tokens").alias("__n"))
    before = totals.select("__file", F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return files.join(F.broadcast(before), F.col("file") == F.col("__file")).withColumn("start", F.col("__before") + F.col("file_start")).drop("__file", "__before")


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, all from the files."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts(files).select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return digests(read(docs.sparkSession, path))
