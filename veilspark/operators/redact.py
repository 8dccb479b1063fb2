"""The scanner as Spark columns: one Arrow UDF per configuration, and what follows from it."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig

#: A finding's line counts from 1, its start from 0 in characters of the line (null where the value was decoded first).
FINDINGS = "array<struct<strategy:string,label:string,line:int,start:int,length:int>>"
RESULT = f"redacted string, findings {FINDINGS}, error string"
_FINDING = pa.struct([("strategy", pa.string()), ("label", pa.string()), ("line", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])


def ship(spark: SparkSession) -> None:
    """Let local Python workers import this package from where it lies; clusters use --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def _results(scanner, texts: pa.Array, closed: bool, keep_text: bool) -> pa.StructArray:
    redacted, errors, ends = [], [], [0]
    columns: list[list] = [[], [], [], [], []]
    for text in texts.to_pylist():
        out, findings, error = scanner.scan(text, closed) if text is not None else (None, [], None)
        redacted.append(out if keep_text else None)
        errors.append(error)
        for f in findings:
            for column, value in zip(columns, (f.strategy, f.label, f.line, f.start, len(f.value))):
                column.append(value)
        ends.append(len(columns[0]))
    rows = pa.StructArray.from_arrays([pa.array(c, field.type) for c, field in zip(columns, _FINDING)], fields=list(_FINDING))
    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
    return pa.StructArray.from_arrays([pa.array(redacted, pa.string()), found, pa.array(errors, pa.string())], names=["redacted", "findings", "error"])


def scan(config: ScanConfig, closed: bool = False, keep_text: bool = True):
    """An Arrow UDF: text (of one or more lines) to RESULT, by `Scanner.scan`'s policy for lines. Without
    keep_text, `redacted` is null and no text comes back from the workers."""

    @F.arrow_udf(RESULT)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from .scan import Scanner

        scanner = Scanner(config)
        for batch in texts:
            yield _results(scanner, batch, closed, keep_text)

    return run


def redact(df: DataFrame, column: str, config: ScanConfig, audit: bool = False, closed: bool = False) -> DataFrame:
    """df with `column` redacted (left as it is in audit mode) and `findings` and `error` beside it.
    In audit mode nothing is dropped, and no text comes back from the workers."""
    ship(df.sparkSession)
    scanned = df.withColumn("__scan", scan(config, closed and not audit, not audit)(F.col(column)))
    out = {"findings": F.col("__scan.findings"), "error": F.col("__scan.error"), "would_redact": F.size("__scan.findings") > 0}
    return scanned.withColumns(out if audit else {column: F.col("__scan.redacted"), **out}).drop("__scan")


def counts(scanned: DataFrame, *by: str) -> DataFrame:
    """Findings by strategy and label."""
    return scanned.select(*by, F.explode("findings").alias("f")).groupBy(*by, "f.strategy", "f.label").agg(F.count(F.lit(1)).alias("n"))


def spans(scanned: DataFrame, *keep: str) -> DataFrame:
    """One row a finding: keep, strategy, label, line, start and length."""
    return scanned.select(*keep, F.inline("findings"))


def preview(df: DataFrame, column: str, published: ScanConfig, draft: ScanConfig) -> DataFrame:
    """What a draft would change: the line under either configuration, and whether they differ. Both
    scanners see a text in one pass."""
    ship(df.sparkSession)

    @F.arrow_udf("published string, draft string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from .scan import Scanner

        both = Scanner(published), Scanner(draft)
        for batch in texts:
            sides = [pa.array([None if t is None else s.scan(t)[0] for t in batch.to_pylist()], pa.string()) for s in both]
            yield pa.StructArray.from_arrays(sides, names=["published", "draft"])

    rows = df.withColumn("__both", run(F.col(column)))
    return rows.withColumns({"published": F.col("__both.published"), "draft": F.col("__both.draft")}).withColumn("changed", ~F.col("published").eqNullSafe(F.col("draft"))).drop("__both")


def register(spark: SparkSession, config: ScanConfig, name: str = "scan") -> None:
    """For SQL: the UDF under a name, and `redaction_spans(text)`, a table function of one row a finding."""
    ship(spark)
    spark.udf.register(name, scan(config))

    @F.udtf(returnType="strategy string, label string, line int, start int, length int")
    class Spans:
        def __init__(self):
            from veilspark.operators.scan import Scanner

            self.scanner = Scanner(config)

        def eval(self, text: str):
            for f in self.scanner.scan(text)[1] if text is not None else ():
                yield f.strategy, f.label, f.line, f.start, len(f.value)

    spark.udtf.register("redaction_spans", Spans)


def lines(text: Column) -> Column:
    return F.split(text, "\n")
