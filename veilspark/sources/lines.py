"""Log lines as rows: only a line feed ends a line, and one carriage return before it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder, as a tailed log that is rotated into it."""
    return spark.readStream.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.option("lineSep", "\n").text(path)


def write_stream_lines(df: DataFrame, path: str, checkpoint: str):
    """A stream's lines into files of a folder; the trigger's interval takes the place of a flush timer."""
    return df.select("value").writeStream.format("text").option("lineSep", "\n").option("path", path).option("checkpointLocation", checkpoint)
