"""Counters: growth, windowed reports, cluster summaries and alert conditions over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth(samples: DataFrame, key: str, order: list[str], value: str, out: str = "growth") -> DataFrame:
    """Rise of a counter since its key's sample before; a fall means a restart from zero; the first
    sample of a key has none."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return samples.withColumn(out, F.when(before.isNull(), 0.0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value)))


def bounded_label(label: Column, known: list[str], other: str = "other") -> Column:
    return F.when(label.isNull() | (label == ""), "unknown").when(label.isin(*known), label).otherwise(other)


def histogram(df: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """Cumulative counts under each bound, as rows (by..., le, n), the last bound infinite."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias(f"b{len(bounds)}"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds, float("inf")])])
    return counts.select(*by, F.inline(rows))


def histogram_quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """Linear interpolation inside the first bucket that reaches q of all (the highest bound if that
    bucket is the infinite one)."""
    w = Window.partitionBy(*by).orderBy("le") if by else Window.orderBy("le")
    rows = buckets.withColumns({"n0": F.coalesce(F.lag("n").over(w), F.lit(0)), "le0": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "total": F.max("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    hit = rows.filter((F.col("n") >= q * F.col("total")) & (F.col("n0") < q * F.col("total")))
    inside = F.col("le0") + (F.col("le") - F.col("le0")) * (q * F.col("total") - F.col("n0")) / (F.col("n") - F.col("n0"))
    return hit.select(*by, F.when(F.col("le") == float("inf"), F.col("le0")).otherwise(inside).alias("quantile"))


def cluster_summary(reports: DataFrame, by: list[str], order: str, latest: list[str], sums: list[str]) -> DataFrame:
    """One row a group: the latest report's own columns, sums over all, how many and when last."""
    newest = F.max_by(F.struct(*latest), order).alias("newest")
    return reports.groupBy(*by).agg(newest, F.max(order).alias("last"), F.count(F.lit(1)).alias("reports"), *[F.sum(c).alias(f"sum_{c}") for c in sums]).select(*by, "newest.*", "last", "reports", *[f"sum_{c}" for c in sums])


def epoch_seconds(at: str) -> Column:
    """Whole seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({at} AS TIMESTAMP_NTZ))")


def rise_over(samples: DataFrame, key: str, at: str, rise: str, seconds: int) -> Column:
    """Sum of a rise over the last `seconds` of the key, the row's own moment included."""
    return F.sum(rise).over(Window.partitionBy(key).orderBy(epoch_seconds(at)).rangeBetween(-seconds, 0))


def upsert_sum(base: DataFrame, more: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Insert or add: the union summed by key, which is what a merge would leave."""
    return base.unionByName(more).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
