"""Alert conditions over counter samples: rates over time steps, durations, thresholds.

Rates are growth over the window divided by its length, without extrapolation to its edges. What is
summed over all keys is first summed by time step, so only one row a step meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counters import epoch_seconds


def held_for(rows: DataFrame, condition: Column, key: list[str], at: str, order: list[str], seconds: int, out: str = "firing") -> DataFrame:
    """rows with `out`: whether the condition has held without a break for at least `seconds` of the key."""
    now = Window.partitionBy(*key).orderBy(*order)
    run = rows.withColumn("__on", F.coalesce(condition, F.lit(False))).withColumn("__run", F.count_if(~F.col("__on")).over(now.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(F.when(F.col("__on"), epoch_seconds(at))).over(Window.partitionBy(*key, "__run"))
    return run.withColumn(out, F.col("__on") & (epoch_seconds(at) - since >= seconds)).drop("__on", "__run")


def by_step(samples: DataFrame, at: str, rise: str, step: int, *by: str) -> DataFrame:
    """by, step (its start in seconds) and the sum of a rise, for each step that has samples."""
    start = (F.floor(epoch_seconds(at) / step) * step).cast("long")
    return samples.groupBy(*by, start.alias("step")).agg(F.sum(rise).alias("rise"))


def every_step(steps: DataFrame, step: int) -> DataFrame:
    """steps (of one series) with rows of rise 0 for the empty ones between its first and last."""
    ends = steps.agg(F.min("step").alias("a"), F.max("step").alias("b")).filter("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("step")).join(steps, "step", "left").select("step", F.coalesce("rise", F.lit(0)).alias("rise"))


def rate(steps: DataFrame, seconds: int, step: int, *by: str) -> DataFrame:
    """steps with `rate`: the rise of the last `seconds`, a second."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("step").rangeBetween(-(seconds - step), 0)
    return steps.withColumn("rate", F.sum("rise").over(w) / F.lit(float(seconds)))


def bucket_growth(samples: DataFrame, at: str, value: str, bounds: list[float], step: int) -> DataFrame:
    """step, le, n: for each step the cumulative counts under each bound, as `histogram_quantile` takes them."""
    start = (F.floor(epoch_seconds(at) / step) * step).cast("long")
    counts = samples.groupBy(start.alias("step")).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias(f"b{len(bounds)}"))
    return counts.select("step", F.inline(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds, float("inf")])])))


def thresholds(metrics: DataFrame, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """alert, value and firing for rows (metric, value): rules (alert, metric, '<' or '>', bound), which
    are few and given. A metric without a row fires nothing."""
    table = metrics.sparkSession.createDataFrame(rules, "alert string, __metric string, sign string, bound double")
    met = metrics.join(F.broadcast(table), F.col("metric") == F.col("__metric"))
    return met.select("alert", "value", F.when(F.col("sign") == "<", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound")).alias("firing"))
