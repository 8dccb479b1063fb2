"""Policy versions as tables: publishing, last good fetch, validation, and line differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def human_bytes(n: Column, units: str = "KMGTPE") -> Column:
    """Bytes with a unit of 1024s (the last of `units` at most) and one decimal; below 1024, whole bytes."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units, 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", F.bround(n / float(1024**i), 1)), F.lit(f" {unit}B"))).otherwise(out)
    return out


def etag_matches(header: Column, etag: Column) -> Column:
    """Whether an If-None-Match header names the tag (weak or strong) or is a star."""
    tags = F.transform(F.split(header, ","), lambda x: F.regexp_replace(F.trim(x), "^W/", ""))
    return F.coalesce((F.trim(header) == "*") | ((F.trim(header) != "") & F.array_contains(tags, etag)), F.lit(False))


def last_good(fetches: DataFrame, key: str, at: list[str], good: str, body: str) -> DataFrame:
    """For each fetch the body in force: its own if good, else that of the latest good one before;
    and whether it is a fallback (or null if none was ever good)."""
    w = Window.partitionBy(key).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    return fetches.withColumn("in_force", F.last(F.when(F.col(good), F.col(body)), ignorenulls=True).over(w)).withColumn("fallback", ~F.col(good) & F.col("in_force").isNotNull())


def next_version(versions: DataFrame, key: str, number: str) -> DataFrame:
    return versions.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def appended(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """An append-only table with new rows; those whose key exists already are left out."""
    return base.unionByName(more.join(base.select(*keys), keys, "left_anti"))


def publish(publications: DataFrame, requests: DataFrame, key: str, revision: str, order: list[str]) -> DataFrame:
    """publications (key, seq, revision) with the requests (key, revision, order...) appended in their order,
    numbered on from each key's last. Publishing an older revision again is a rollback: nothing is taken out."""
    last = publications.groupBy(F.col(key).alias("__key")).agg(F.max("seq").alias("__last"))
    numbered = requests.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    added = numbered.join(last, F.col(key) == F.col("__key"), "left").select(key, (F.coalesce("__last", F.lit(0)) + F.col("__n")).alias("seq"), revision)
    return publications.select(key, "seq", revision).unionByName(added)


def in_force(publications: DataFrame, key: str, revision: str) -> DataFrame:
    """The revision of each key's last publication, and whether an older publication had it before (a rollback)."""
    w = Window.partitionBy(key)
    last = publications.withColumn("__last", F.max("seq").over(w)).withColumn("__top", F.max(F.struct("seq", revision)).over(w)[revision])
    return last.groupBy(key).agg(F.max("seq").alias("seq"), F.max_by(revision, "seq").alias(revision), (F.count_if((F.col(revision) == F.col("__top")) & (F.col("seq") < F.col("__last"))) > 0).alias("rollback"))


def line_diff(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """A longest common subsequence of the lines kept (space), the others added (+) or removed (-); where
    both keep as many, additions come first. Equal ends are set aside, so the table covers the changed part."""
    head = 0
    while head < min(len(before), len(after)) and before[head] == after[head]:
        head += 1
    a, b = before[head:], after[head:]
    # longest[i][j]: lines that the rest of a from i and of b from j have in common
    longest = [[0] * (len(b) + 1)]
    for x in reversed(a):
        below, row = longest[-1], [0]
        for j in range(len(b) - 1, -1, -1):
            row.append(below[j + 1] + 1 if x == b[j] else max(below[j], row[-1]))
        longest.append(row[::-1])
    longest.reverse()
    out, i, j = [(" ", x) for x in before[:head]], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append((" ", a[i]))
            i, j = i + 1, j + 1
        elif j < len(b) and (i == len(a) or longest[i][j + 1] >= longest[i + 1][j]):
            out.append(("+", b[j]))
            j += 1
        else:
            out.append(("-", a[i]))
            i += 1
    return out


@udtf(returnType="op string, line string")
class DiffLines:
    """Lines of two texts, as `line_diff` orders them."""

    def eval(self, before: str, after: str):
        yield from line_diff((before or "").split("\n"), (after or "").split("\n"))
