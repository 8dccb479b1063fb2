"""Operator 5: contiguous shards of near-equal bytes, with DataFrame functions only.

Rows are put in one global order (by default: hash of the text, then doc_id, so that equal texts
lie together). One small row for each document - never its text - is range-partitioned by that order
and written to the shared folder. Per-partition totals give each partition its offset, a running sum
within the partition gives each row its global byte prefix, and the prefix's place among equal byte
targets is its shard.

Equal texts share a shard: a target inside their group moves to the group's nearer border. Only a
group that would move it by more than `SLACK` of a shard is parted there, so that the sizes stay near
equal whatever one group holds.

Null text: size 1, and the CRC of the empty text. Null ids sort first; repeated rows stay, each
with its own slot. An empty table gives an empty result; columns that clash with the output's are left
out. A row larger than a target fills its shard alone; others may then be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, partitions, whole_text

LAW = "bytes"
#: Share of a shard by which a cut may move to keep a group of equal texts whole.
SLACK = 0.05


def ordered_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df, written in the global order of keys, with `part` and `place` (from 0 in each part)."""
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    # one number for both: the partition above bit 33, the row within it below
    numbered = dealt.withColumn("__n", F.monotonically_increasing_id())
    written = materialize(numbered, name)
    return written.withColumns({"part": F.shiftright("__n", 33).cast("int"), "place": F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__n")


def prefix_sums(rows: DataFrame, size: str) -> DataFrame:
    """rows with `before` (sum of size over all earlier rows), `row_before` and `total`. Only one
    row for each partition meets in one place, and as many are broadcast."""
    totals = rows.groupBy("part").agg(F.sum(size).alias("__size"), F.count(F.lit(1)).alias("__rows"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        F.col("part").alias("__part"), F.coalesce(F.sum("__size").over(order), F.lit(0)).alias("__size_before"),
        F.coalesce(F.sum("__rows").over(order), F.lit(0)).alias("__rows_before"), F.sum("__size").over(everything).alias("total"),
    )
    running = F.coalesce(F.sum(size).over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.withColumn("__own", running).join(F.broadcast(offsets), F.col("part") == F.col("__part"))
    return joined.withColumns({"before": F.col("__size_before") + F.col("__own"), "row_before": F.col("__rows_before") + F.col("place")}).drop("__part", "__size_before", "__rows_before", "__own")


def cuts(placed: DataFrame, shards: int, slack: float) -> DataFrame:
    """One row: `cuts`, the bytes before shards 1, 2, ..., times `shards`. placed: prefix_sums with `group`.

    A target that lies inside a group of rows moves to the nearer border of the group, if that is at
    most `slack` of a shard away. Only the few groups at targets are looked up."""
    numbers = F.explode(F.sequence(F.lit(1), F.lit(shards - 1))) if shards > 1 else F.explode(F.array().cast("array<int>"))
    at = placed.filter(F.expr(f"(before * {shards} + total - 1) div total <= ((before + size) * {shards} - 1) div total")).select(F.col("group").alias("__group")).distinct()
    spans = placed.join(F.broadcast(at), F.col("group") == F.col("__group")).groupBy("group").agg(F.min("before").alias("start"), F.max(F.col("before") + F.col("size")).alias("end"), F.max("total").alias("total"))
    target, start, end = F.col("s") * F.col("total"), F.col("start") * shards, F.col("end") * shards
    border = F.when(target - start <= end - target, start).otherwise(end)
    inside = spans.withColumn("s", numbers).filter((start < target) & (target < end))
    moved = inside.select(F.col("s").alias("__s"), F.when(F.abs(border - target) <= F.lit(slack) * F.col("total"), border).otherwise(target).alias("cut"))
    every = placed.agg(F.max("total").alias("total")).withColumn("s", numbers)
    return every.join(moved, F.col("s") == F.col("__s"), "left").agg(F.sort_array(F.collect_list(F.coalesce("cut", target))).alias("cuts"))


def assign(docs: DataFrame, shards: int = 8, order: list[Column] | None = None, slack: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document.

    A row goes where the middle of its bytes falls among the cuts, so each shard's bytes differ from
    an equal share by at most a row or the slack at either end. Rows whose first key of the order is
    equal (by default: equal texts) are a group."""
    text = whole_text()
    order = [F.md5(text), F.col("doc_id")] if order is None else order
    size = F.octet_length(text).cast("long") + 1
    small = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[c.alias(f"__k{i}") for i, c in enumerate(order)])
    rows = ordered_rows(small, [f"__k{i}" for i in range(len(order))], "shards").select("doc_id", "size", "text_crc32", F.xxhash64("__k0").alias("group"), "part", "place")
    placed = materialize(prefix_sums(rows, "size"), "prefixes")  # a few numbers a row, read for cuts, first rows and slots
    one = F.broadcast(materialize(cuts(placed, shards, SLACK if slack is None else slack), "cuts"))
    dealt = placed.join(one).withColumn("shard", F.size(F.filter("cuts", lambda c: (2 * F.col("before") + F.col("size")) * shards >= 2 * c)))
    first = dealt.groupBy(F.col("shard").alias("__shard")).agg(F.min("row_before").alias("__first"))
    return dealt.join(F.broadcast(first), F.col("shard") == F.col("__shard")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("row_before") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
