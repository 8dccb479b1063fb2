"""Queries of the telemetry and policy planes over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import native
from ..operators import counters
from .detect import CARDS, table

BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("hit", F.size(native.card_runs(F.col("text"))) > 0)
    return docs.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.octet_length("text")).alias("n_bytes"), F.count_if("hit").alias("would_redact"), F.round(100.0 * F.count_if("hit") / F.count(F.lit(1)), 4).alias("percent"))


AUDIT_SQL = f"WITH {CARDS} SELECT lang, source, count(*) AS n_texts, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM cards)) AS would_redact, round(100.0 * count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM cards)) / count(*), 4)::DOUBLE AS percent FROM documents GROUP BY lang, source"


def bounded_labels(spark, sf_dir):
    label = counters.bounded_label(F.col("event_type"), ["click", "view"])
    return table(spark, sf_dir, "events").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(spark, sf_dir):
    return counters.histogram(table(spark, sf_dir, "events"), "value", BOUNDS, "event_type")


HISTOGRAM_SQL = "SELECT event_type, le, n FROM (" + " UNION ALL ".join(f"SELECT event_type, {b if b is not None else chr(39) + 'Infinity' + chr(39)}::DOUBLE AS le, count(*) FILTER (WHERE {'value <= ' + str(b) if b is not None else 'true'}) AS n FROM events GROUP BY event_type" for b in [*BOUNDS, None]) + ")"


def latency_quantile(spark, sf_dir):
    buckets = counters.histogram(table(spark, sf_dir, "events"), "value", BOUNDS, "event_type")
    return counters.histogram_quantile(buckets, 0.95, "event_type").withColumn("quantile", F.round("quantile", 6))


QUANTILE_SQL = f"""WITH b AS ({HISTOGRAM_SQL}), w AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY le), 0) AS n0, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS le0, max(n) OVER (PARTITION BY event_type) AS total FROM b)
SELECT event_type, round(CASE WHEN le = 'Infinity'::DOUBLE THEN le0 ELSE le0 + (le - le0) * (0.95 * total - n0) / (n - n0) END, 6)::DOUBLE AS quantile FROM w WHERE n >= 0.95 * total AND n0 < 0.95 * total"""


def counter_growth(spark, sf_dir):
    rows = counters.growth(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("growth").cast("decimal(30,10)")).cast("double"), 4).alias("growth"), F.count(F.lit(1)).alias("samples"))


GROWTH = "SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END AS growth FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"


def window_report(spark, sf_dir):
    w = F.window("ts", "5 minutes")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(30,10)")).cast("double"), 4).alias("total")).select(counters.epoch_seconds("w.start").alias("from_s"), "event_type", "n", "total")


def cluster_summary(spark, sf_dir):
    out = counters.cluster_summary(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", ["value", "props"], ["event_id"])
    return out.select("user_id", "event_type", F.round("value", 6).alias("value"), "props", "last", "reports", "sum_event_id").orderBy(F.desc("last"))


def publications(spark, sf_dir):
    """Orders as publications of their customer's rule set: how many, the highest number, the next one
    and the one latest by number; customers without any keep zero."""
    sets, pubs = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders")
    latest = pubs.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return sets.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("top", F.lit(0)) + 1).alias("next_number"), "status")


PUBLICATIONS_SQL = """SELECT c_custkey, c_name, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) AS n, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), 0) + 1 AS next_number,
(SELECT arg_max(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS status FROM customer"""


def pulls(spark, sf_dir):
    """Events as pulls of a user: today and in the last seven days, by the newest day; customers without stay."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    per_day = events.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")).withColumn("today", events.agg(F.max("day")).scalar())
    recent = per_day.groupBy("user_id").agg(F.sum(F.when(F.col("day") == F.col("today"), F.col("n")).otherwise(0)).alias("d"), F.sum(F.when(F.datediff("today", "day") < 7, F.col("n")).otherwise(0)).alias("w"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    return users.join(recent, F.col("user") == F.col("user_id"), "left").select("user", F.coalesce("d", F.lit(0)).alias("today"), F.coalesce("w", F.lit(0)).alias("week"))


PULLS_SQL = """WITH t AS (SELECT max(ts::DATE) AS today FROM events), r AS (SELECT user_id, count(*) FILTER (WHERE ts::DATE = today) AS d, count(*) FILTER (WHERE today - ts::DATE < 7) AS w FROM events, t GROUP BY user_id)
SELECT c_custkey AS "user", coalesce(d, 0) AS today, coalesce(w, 0) AS week FROM customer LEFT JOIN r ON user_id = c_custkey"""


def upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.lit(1).cast("long").alias("pulls"))
    base = events.groupBy("user_id", "day").agg(F.sum("pulls").alias("pulls"))
    more = events.filter("user_id % 2 = 0")
    return counters.upsert_sum(base, more, ["user_id", "day"], ["pulls"])


def keyset_page(spark, sf_dir):
    """A page of the log: newest first, ids under the cursor, at most the page's size."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O' and o_orderkey < 40000").select("o_orderkey", "o_custkey").orderBy(F.desc("o_orderkey")).limit(100)


def trusted_and_gone(spark, sf_dir):
    """Customers with an urgent order (semi) and those with no order at all (anti)."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    urgent = customers.join(orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").withColumn("state", F.lit("trusted"))
    return urgent.unionByName(customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").withColumn("state", F.lit("gone")))


def retention(spark, sf_dir):
    """Rows of the last 90 days of the log, and whether a conditional touch would write."""
    orders = table(spark, sf_dir, "orders")
    kept = orders.filter(F.col("o_orderdate") >= F.date_sub(orders.agg(F.max("o_orderdate")).scalar(), 90))
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return kept.select("o_orderkey", (before.isNull() | (F.datediff("o_orderdate", before) >= 7)).alias("touch"))


RETENTION_SQL = """WITH k AS (SELECT * FROM orders, (SELECT max(o_orderdate) AS last FROM orders) WHERE o_orderdate::DATE >= last::DATE - 90)
SELECT o_orderkey, coalesce(o_orderdate::DATE - lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) >= 7, true) AS touch FROM k"""


def alerts(spark, sf_dir):
    """For each sample: growth over the last hour, and which conditions hold (rate high, nothing
    grew, stale after three hours without a sample)."""
    rows = counters.growth(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    rows = rows.withColumn("whole", F.round("growth").cast("long"))
    hour = counters.rise_over(rows, "user_id", "ts", "whole", 3600)
    gap = counters.epoch_seconds("ts") - F.lag(counters.epoch_seconds("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select("event_id", hour.alias("increase"), (hour > 100).alias("high"), (hour == 0).alias("silent"), F.coalesce(gap > 3 * 3600, F.lit(False)).alias("stale"))


ALERTS_SQL = f"""WITH g AS ({GROWTH}), w AS (SELECT event_id, user_id, ts, round(growth)::BIGINT AS whole, floor(epoch(ts))::BIGINT AS s FROM g),
h AS (SELECT event_id, sum(whole) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)::BIGINT AS increase, s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM w)
SELECT event_id, increase, increase > 100 AS high, increase = 0 AS silent, coalesce(gap > 10800, false) AS stale FROM h"""


def metrics_text(spark, sf_dir):
    """Counter lines `name{label="v",...} value`, written from events and parsed again; values that
    are no finite number of zero or more are dropped."""
    line = F.concat(F.lit('pii_redactions_total{strategy="'), "event_type", F.lit('",user="'), F.col("user_id").cast("string"), F.lit('"} '), F.when(F.col("event_id") % 7 == 0, "NaN").when(F.col("event_id") % 11 == 0, "-1").otherwise(F.col("event_id").cast("string")))
    lines = table(spark, sf_dir, "events").select(line.alias("line"))
    from ..sources.metrics import parse_metrics

    return parse_metrics(lines, "line").groupBy("series", F.col("labels")["strategy"].alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def statements(spark, sf_dir):
    """Signed-statement text, entity tag and revision string of orders as published policies."""
    body = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    etag = F.concat(F.lit('"'), F.substring(F.sha2(body, 256), 1, 32), F.lit('"'))
    text = F.concat(F.lit("publication\nset: "), F.col("o_custkey").cast("string"), F.lit("\nseq: "), F.col("o_orderkey").cast("string"), F.lit("\netag: "), etag, F.lit("\n"))
    revision = F.concat(F.col("o_orderstatus"), F.lit("+"), (F.col("o_orderkey") % 9).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", etag.alias("etag"), F.md5(text).alias("statement_md5"), revision.alias("revision"))


STATEMENTS_SQL = """WITH e AS (SELECT *, '"' || substr(sha256(o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || o_orderpriority), 1, 32) || '"' AS etag FROM orders)
SELECT o_orderkey, etag, md5('publication' || chr(10) || 'set: ' || o_custkey::VARCHAR || chr(10) || 'seq: ' || o_orderkey::VARCHAR || chr(10) || 'etag: ' || etag || chr(10)) AS statement_md5, o_orderstatus || '+' || (o_orderkey % 9)::VARCHAR AS revision FROM e"""


def score_rollup(spark, sf_dir):
    """How often texts would be redacted, by label and length class, with subtotals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") < 500, "short").when(F.length("text") < 3000, "middle").otherwise("long").alias("bucket"), (F.size(native.card_runs(F.col("text"))) > 0).alias("hit"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.rollup("quality", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("redacted"), F.grouping_id().alias("level"))


ROLLUP_SQL = f"""WITH {CARDS}, d AS (SELECT quality, CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 3000 THEN 'middle' ELSE 'long' END AS bucket, doc_id IN (SELECT doc_id FROM cards) AS hit FROM documents JOIN labels USING (doc_id))
SELECT quality, bucket, count(*) AS n, count(*) FILTER (WHERE hit) AS redacted, grouping_id(quality, bucket) AS level FROM d GROUP BY ROLLUP (quality, bucket)"""

QUERIES = {
    "audit_summary": (audit_summary, AUDIT_SQL),
    "bounded_labels": (bounded_labels, "SELECT CASE WHEN event_type IS NULL OR event_type = '' THEN 'unknown' WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY 1"),
    "latency_histogram": (latency_histogram, HISTOGRAM_SQL),
    "latency_quantile": (latency_quantile, QUANTILE_SQL),
    "counter_growth": (counter_growth, f"SELECT user_id, round(sum(growth::DECIMAL(30, 10))::DOUBLE, 4) AS growth, count(*) AS samples FROM ({GROWTH}) GROUP BY user_id"),
    "window_report": (window_report, "SELECT (floor(epoch(ts) / 300) * 300)::BIGINT AS from_s, event_type, count(*) AS n, round(sum(value::DECIMAL(30, 10))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2"),
    "cluster_summary": (cluster_summary, "SELECT user_id, event_type, round(arg_max(value, event_id), 6) AS value, arg_max(props, event_id) AS props, max(event_id) AS last, count(*) AS reports, sum(event_id)::BIGINT AS sum_event_id FROM events GROUP BY 1, 2"),
    "publications": (publications, PUBLICATIONS_SQL),
    "pulls": (pulls, PULLS_SQL),
    "upsert": (upsert, "SELECT user_id, ts::DATE AS day, count(*) * CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS pulls FROM events GROUP BY user_id, ts::DATE"),
    "keyset_page": (keyset_page, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey < 40000 ORDER BY o_orderkey DESC LIMIT 100"),
    "trusted_and_gone": (trusted_and_gone, "SELECT c_custkey, 'trusted' AS state FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') UNION ALL SELECT c_custkey, 'gone' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "retention": (retention, RETENTION_SQL),
    "alerts": (alerts, ALERTS_SQL),
    "metrics_text": (metrics_text, "SELECT 'pii_redactions_total' AS series, event_type AS strategy, count(*) AS n, sum(event_id)::DOUBLE AS total FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY event_type"),
    "statements": (statements, STATEMENTS_SQL),
    "score_rollup": (score_rollup, ROLLUP_SQL),
}
