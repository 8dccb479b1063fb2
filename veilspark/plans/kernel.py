"""Queries of the scan UDF and of line assembly: no SQL expresses the scanner."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ScanConfig
from ..operators import redact
from ..streaming.assemble import assemble
from .detect import SALT, table

CONFIG = ScanConfig(salt=SALT)


def scan_documents(spark, sf_dir):
    scanned = redact.redact(table(spark, sf_dir, "documents").select("lang", "source", "text"), "text", CONFIG, audit=True)
    return redact.counts(scanned, "lang", "source")


def redact_conversations(spark, sf_dir):
    return redact.redact(table(spark, sf_dir, "conversations"), "text", CONFIG).select("conv_id", "turn", F.md5("text").alias("text_md5"), "would_redact", "error")


def preview_rules(spark, sf_dir):
    draft = ScanConfig(salt=SALT, entropy_threshold=3.0)
    return redact.preview(table(spark, sf_dir, "pages").select("page_id", "url"), "url", CONFIG, draft).select("page_id", "published", "draft", "changed")


def assemble_lines(spark, sf_dir):
    """Event payloads as writes of a process, three bytes short of a line end each other row."""
    events = table(spark, sf_dir, "events")
    data = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, F.lit("\n")).otherwise(F.lit("-")))
    writes = events.select((F.col("user_id") % 50).cast("int").alias("tgid"), (F.col("event_id") % 2 + 1).cast("int").alias("fd"), F.col("event_id").alias("seq"), data.cast("binary").alias("data"))
    return assemble(writes).groupBy("tgid", "fd").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


ASSEMBLE_SQL = """WITH w AS (SELECT (user_id % 50)::INT AS tgid, (event_id % 2 + 1)::INT AS fd, event_id AS seq, event_type || CASE WHEN event_id % 2 = 0 THEN chr(10) ELSE '-' END AS data FROM events),
t AS (SELECT tgid, fd, string_agg(data, '' ORDER BY seq) AS text FROM w GROUP BY tgid, fd), l AS (SELECT tgid, fd, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS line FROM t)
SELECT tgid, fd, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM l GROUP BY tgid, fd"""

QUERIES = {"scan_documents": (scan_documents, None), "redact_conversations": (redact_conversations, None), "preview_rules": (preview_rules, None), "assemble_lines": (assemble_lines, ASSEMBLE_SQL)}
