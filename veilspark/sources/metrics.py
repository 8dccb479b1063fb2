"""Counter samples in the plain-text exposition format, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_metrics(df: DataFrame, line: str) -> DataFrame:
    """series, labels (map) and value of each sample line; comments, bad lines and values that are
    not finite or are negative are dropped. In label values \\\\, \\" and \\n are taken back."""
    sample = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{(.*)\})?\s+(\S+)(\s+-?[0-9]+)?\s*$"
    pair = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'
    rows = df.select(F.regexp_extract(line, sample, 1).alias("series"), F.regexp_extract(line, sample, 3).alias("body"), F.regexp_extract(line, sample, 4).try_cast("double").alias("value"))
    def plain(v):  # a mark no text holds keeps doubled backslashes apart from escapes
        held = F.replace(v, F.lit("\\\\"), F.lit("\x00"))
        return F.replace(F.replace(F.replace(held, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))
    names, values = F.regexp_extract_all("body", F.lit(pair), F.lit(1)), F.transform(F.regexp_extract_all("body", F.lit(pair), F.lit(2)), plain)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < float("inf"))
    return rows.filter((F.col("series") != "") & finite).select("series", F.map_from_arrays(names, values).alias("labels"), "value")
