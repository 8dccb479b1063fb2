"""What the corpus operators have in common: the shared folder, worker memos, slices."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: the space and U+0009 to U+000D.
BLANKS = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without that setting (tests, a laptop) gets a temporary folder of its own; on a
    cluster each executor would write to its own disk, so it raises there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilspark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the session's file system closes."""
    path = f"{shared_dir(spark)}/veilspark-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: How shared tables are written: small row groups and a codec without buffers of its own keep writers small.
FORMAT = {"compression": "zstd", "parquet.block.size": str(32 << 20)}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and any lost
    executor's work can be read again instead of being computed again."""
    path = new_path(df.sparkSession, name)
    df.write.options(**FORMAT).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Most rows of `spread_join`'s broadcast part, and rows that may meet in one task without being split.
HEAVY, EASY = 50_000, 2_000_000


def spread_join(rows: DataFrame, small: DataFrame, key: str, value: str, n: str, total: int) -> DataFrame:
    """rows with the `value` that `small` has for `key` (one row a key; n: how many of the `total` rows have it).

    Keys with over total / HEAVY rows are at most HEAVY keys, whatever the table, so their values are
    broadcast; no other key holds more rows than that share, so those are joined by an exchange. While all
    rows together are few, no key needs splitting."""
    if total <= EASY:
        given = small.select(F.col(key).alias("__key2"), F.col(value).alias("__value2"))
        return rows.join(given, F.col(key) == F.col("__key2")).select(*rows.columns, F.col("__value2").alias(value))
    heavy = small.filter(F.col(n) * HEAVY > total).select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    light = small.filter(F.col(n) * HEAVY <= total).select(F.col(key).alias("__key2"), F.col(value).alias("__value2"))
    met = rows.join(F.broadcast(heavy), F.col(key) == F.col("__key"), "left")
    done = met.filter("__key is not null").select(*rows.columns, F.col("__value").alias(value))
    rest = met.filter("__key is null").select(*rows.columns).join(light.hint("merge"), F.col(key) == F.col("__key2")).select(*rows.columns, F.col("__value2").alias(value))
    return done.unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Let local Python workers import this package from where it lies; clusters use --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(texts: list[str], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` characters at a time (a longer text stands alone),
    so that a worker's temporary arrays stay small whatever the batch holds."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def portions(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(name).to_pylist()


class IntTable:
    """Distinct whole numbers from 0 on, and the place of each: an open-addressing table, so that a lookup
    of many is a few gathers."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]], self.places[at[free]] = keys[left[free]], left[free]  # the last of a slot's keys takes it
            stays = self.keys[at] != keys[left]
            left, at = left[stays], (at[stays] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that aren't there."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.places[at], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at_left = at[left] = (at[left] + 1) & self.mask
            held = self.keys[at_left]
            hit = held == keys[left]
            out[left[hit]] = self.places[at_left[hit]]
            left = left[~hit & (held >= 0)]
        return out
