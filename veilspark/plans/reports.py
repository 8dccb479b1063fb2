"""Queries of alerts, reports, records and written numbers over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import native
from ..operators import alerts, counters, reports
from ..streaming import assemble
from . import detect
from .detect import table
from .telemetry import BOUNDS, GROWTH

SECONDS = "floor(epoch(ts))::BIGINT"


def _growth(spark, sf_dir):
    rows = counters.growth(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return rows.withColumn("whole", F.round("growth").cast("long"))


def target_down(spark, sf_dir):
    """Users as targets, down while the value is under 20: firing after an hour without a break."""
    events = table(spark, sf_dir, "events")
    return alerts.held_for(events, F.col("value") < 20, ["user_id"], "ts", ["ts", "event_id"], 3600).select("event_id", "firing")


DOWN_SQL = f"""WITH r AS (SELECT *, value < 20 AS on_, {SECONDS} AS s, count(*) FILTER (WHERE NOT value < 20) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT event_id, on_ AND s - min(s) FILTER (WHERE on_) OVER (PARTITION BY user_id, run) >= 3600 AS firing FROM r"""


def error_rate(spark, sf_dir):
    """Growth a second over all users, in the last 30 minutes of each ten, and whether it is high."""
    steps = alerts.by_step(_growth(spark, sf_dir), "ts", "whole", 600)
    return alerts.rate(steps, 1800, 600).select("step", F.round("rate", 6).alias("rate"), (F.col("rate") > 0.05).alias("high"))


STEPS = f"steps AS (SELECT {SECONDS} // 600 * 600 AS step, sum(round(growth)::BIGINT)::BIGINT AS rise FROM ({GROWTH}) GROUP BY 1)"
RATE_SQL = f"WITH {STEPS}, r AS (SELECT step, sum(rise) OVER (ORDER BY step RANGE BETWEEN 1200 PRECEDING AND CURRENT ROW)::DOUBLE / 1800 AS rate FROM steps) SELECT step, round(rate, 6) AS rate, rate > 0.05 AS high FROM r"


def latency_quantiles(spark, sf_dir):
    """The 0.95 quantile of the values of each six hours, by their buckets' growth."""
    buckets = alerts.bucket_growth(table(spark, sf_dir, "events"), "ts", "value", BOUNDS, 21_600)
    return counters.histogram_quantile(buckets, 0.95, "step").select("step", F.round("quantile", 6).alias("quantile"))


QUANTILES_SQL = "WITH b AS (" + " UNION ALL ".join(f"SELECT {SECONDS} // 21600 * 21600 AS step, {b if b is not None else chr(39) + 'Infinity' + chr(39)}::DOUBLE AS le, count(*) FILTER (WHERE {'value <= ' + str(b) if b is not None else 'true'}) AS n FROM events GROUP BY 1" for b in [*BOUNDS, None]) + """),
w AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY step ORDER BY le), 0) AS n0, coalesce(lag(le) OVER (PARTITION BY step ORDER BY le), 0) AS le0, max(n) OVER (PARTITION BY step) AS total FROM b)
SELECT step, round(CASE WHEN le = 'Infinity'::DOUBLE THEN le0 ELSE le0 + (le - le0) * (0.95 * total - n0) / (n - n0) END, 6)::DOUBLE AS quantile FROM w WHERE n >= 0.95 * total AND n0 < 0.95 * total"""


def no_throughput(spark, sf_dir):
    """Steps of a minute, empty ones too: no growth in the last 15 minutes, for half an hour."""
    steps = alerts.every_step(alerts.by_step(_growth(spark, sf_dir), "ts", "whole", 60), 60)
    rates = alerts.rate(steps, 900, 60).withColumns({"at": F.timestamp_seconds("step"), "all": F.lit(0)})
    silent = rates.withColumn("run", F.count_if(F.col("rate") != 0).over(Window.partitionBy("all").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(F.when(F.col("rate") == 0, F.col("step"))).over(Window.partitionBy("run"))
    return silent.select("step", ((F.col("rate") == 0) & (F.col("step") - since >= 1800)).alias("firing")).filter("firing")


THROUGHPUT_SQL = f"""WITH g AS (SELECT {SECONDS} // 60 * 60 AS step, sum(round(growth)::BIGINT)::BIGINT AS rise FROM ({GROWTH}) GROUP BY 1), ends AS (SELECT min(step) AS a, max(step) AS b FROM g),
steps AS (SELECT unnest(range(a, b + 1, 60)) AS step FROM ends), r AS (SELECT step, sum(coalesce(rise, 0)) OVER (ORDER BY step RANGE BETWEEN 840 PRECEDING AND CURRENT ROW) AS rise FROM steps LEFT JOIN g USING (step)),
s AS (SELECT *, count(*) FILTER (WHERE rise <> 0) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT * FROM (SELECT step, rise = 0 AND step - min(step) FILTER (WHERE rise = 0) OVER (PARTITION BY run) >= 1800 AS firing FROM s) WHERE firing"""


def day_findings(spark, sf_dir):
    """By user and kind: growth over the last 24 hours of each sample, and whether there was any."""
    rows = _growth(spark, sf_dir).withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    day = counters.rise_over(rows, "key", "ts", "whole", 86_400)
    return rows.select("event_id", day.alias("increase"), (day > 0).alias("firing"))


DAY_SQL = f"SELECT event_id, increase, increase > 0 AS firing FROM (SELECT event_id, sum(round(growth)::BIGINT) OVER (PARTITION BY user_id, event_type ORDER BY {SECONDS} RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS increase FROM ({GROWTH}))"
RULES = [("few_available", "click", "<", 3000.0), ("many_views", "view", ">", 100.0), ("no_such_metric", "absent", ">", 0.0)]


def threshold_alerts(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return alerts.thresholds(metrics, RULES)


THRESHOLD_SQL = "WITH m AS (SELECT event_type AS metric, count(*)::DOUBLE AS value FROM events GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{a}' AS alert, value, value {sign} {bound} AS firing FROM m WHERE metric = '{m}'" for a, m, sign, bound in RULES)


def set_reports(spark, sf_dir):
    """Events as reports of a token (customer), for one set (nation), of the last 30 days."""
    events, tokens = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").filter("c_nationkey < 5").select("c_custkey", "c_name", "c_nationkey")
    since = F.date_sub(events.agg(F.max(F.to_date("ts"))).scalar(), 30)
    return events.filter(F.to_date("ts") >= since).join(tokens, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", F.col("c_nationkey").alias("set_id"), "event_type")


SET_SQL = "SELECT event_id, c_name, c_nationkey AS set_id, event_type FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey < 5 AND ts::DATE >= (SELECT max(ts::DATE) - 30 FROM events)"


def token_owners(spark, sf_dir):
    """Tokens (customers) with their set (nation) and organisation (region)."""
    tokens, sets, orgs = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return tokens.join(sets, F.col("c_nationkey") == F.col("n_nationkey")).join(orgs, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


def publication_versions(spark, sf_dir):
    """Publications (orders) with the version (customer) that each points to, newest first."""
    pubs, versions = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return pubs.join(versions, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", F.col("c_name").alias("revision")).orderBy(F.desc("o_orderkey"))


def running_pods(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_name", "s_suppkey").orderBy("s_name")


def pods_by_revision(spark, sf_dir):
    """How many events of each kind a user has; kinds of odd events count as unknown."""
    rows = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return reports.counted(rows, ["user_id"], "kind", "revisions").select("user_id", reports.entries_text(F.col("revisions")).alias("revisions"))


PODS_SQL = "WITH c AS (SELECT user_id, CASE WHEN event_id % 3 <> 0 THEN event_type ELSE '' END AS kind, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS revisions FROM c GROUP BY user_id"


def summed_maps(spark, sf_dir):
    """Per user: sums by key over maps that each event carries, and empty maps."""
    maps = F.when(F.col("event_id") % 4 == 0, F.create_map().cast("map<string,bigint>")).otherwise(F.create_map(F.col("event_type"), F.col("event_id"), F.lit("all"), F.lit(1).cast("long")))
    rows = table(spark, sf_dir, "events").select("user_id", maps.alias("redactions"))
    return reports.map_sums(rows, ["user_id"], "redactions").select("user_id", reports.entries_text(F.col("redactions")).alias("redactions"))


MAPS_SQL = """WITH e AS (SELECT user_id, event_type AS k, event_id AS n FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT user_id, 'all', 1 FROM events WHERE event_id % 4 <> 0), s AS (SELECT user_id, k, sum(n)::BIGINT AS n FROM e GROUP BY ALL)
SELECT u.user_id, coalesce((SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM s WHERE s.user_id = u.user_id), '') AS redactions FROM (SELECT DISTINCT user_id FROM events) u"""


def detector_scores(spark, sf_dir):
    """How well symbol-rich text tells bad documents, by language: counts, precision and recall, with totals."""
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (symbols * 50 > F.length("text")).alias("flag"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    out = reports.scores(rows, F.col("quality") == 0, F.col("flag"), "lang")
    return out.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


SCORES_SQL = r"""WITH r AS (SELECT lang, quality = 0 AS t, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))) * 50 > length(text) AS v FROM documents JOIN labels USING (doc_id)),
s AS (SELECT lang, count(*) FILTER (WHERE t AND coalesce(v, false)) AS tp, count(*) FILTER (WHERE NOT t AND coalesce(v, false)) AS fp, count(*) FILTER (WHERE t AND NOT coalesce(v, false)) AS fn, count(*) FILTER (WHERE NOT t AND NOT coalesce(v, false)) AS tn, grouping_id(lang) AS level FROM r GROUP BY ROLLUP (lang))
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6)::DOUBLE AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6)::DOUBLE AS recall FROM s"""


def policy_counts(spark, sf_dir):
    """Policy documents derived from customers: rule counts, and whether they are objects at all."""
    k = F.col("c_custkey")
    keys = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), k % 4)), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('"'))), ",")
    body = F.when(k % 7 == 0, "not json").otherwise(F.concat(F.lit('{"sensitive_keys": ['), keys, F.lit('], "custom_regexes": [{"pattern": "a'), k.cast("string"), F.lit('", "name": "x"}]}')))
    rows = table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))
    return reports.rule_counts(rows, "body").drop("body")


POLICY_SQL = """WITH b AS (SELECT c_custkey, greatest(1, c_custkey % 4) AS n, c_custkey % 7 = 0 AS bad FROM customer)
SELECT c_custkey, CASE WHEN bad THEN 8 ELSE 21 + 5 * n - 1 + 36 + length(c_custkey::VARCHAR) + 16 END::INT AS bytes, NOT bad AS valid, CASE WHEN bad THEN 0 ELSE n END::INT AS n_sensitive_keys, 0 AS n_sensitive_key_patterns, CASE WHEN bad THEN 0 ELSE 1 END::INT AS n_custom_regexes, 0 AS n_safe_regexes FROM b"""


def received_reports(spark, sf_dir):
    """Reports written from events as JSON, some broken in each way: how many are refused for what."""
    i = F.col("event_id")
    body = F.to_json(F.struct(
        F.when(i % 11 == 0, "v0").otherwise("v1").alias("schema"), F.when(i % 13 == 0, "").otherwise("p").alias("policy"), F.when(i % 17 == 0, "other").otherwise("audit").alias("mode"),
        F.lit("2026-01-01T00:00:00").alias("from"), F.when(i % 19 == 0, "2025-01-01T00:00:00").otherwise("2026-01-01T00:05:00").alias("to"),
        F.when(i % 23 == 0, -1).otherwise(5).alias("lines"), F.create_map(F.lit("card"), F.when(i % 29 == 0, -1).otherwise(2)).alias("redactions"),
    ))
    rows = reports.receive(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body", "v1")
    return rows.groupBy("refused").agg(F.count(F.lit(1)).alias("n"), F.sum("report.lines").alias("lines"))


RECEIVED_SQL = """WITH r AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'schema' WHEN event_id % 13 = 0 THEN 'names' WHEN event_id % 17 = 0 THEN 'mode' WHEN event_id % 19 = 0 THEN 'window' WHEN event_id % 23 = 0 THEN 'counts' WHEN event_id % 29 = 0 THEN 'maps' END AS refused, CASE WHEN event_id % 23 = 0 THEN -1 ELSE 5 END AS lines FROM events)
SELECT refused, count(*) AS n, sum(lines)::BIGINT AS lines FROM r GROUP BY refused"""


def replayed_statements(spark, sf_dir):
    """Orders as statements of a customer numbered by price class, some unverified: accepted only while numbers grow."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 7919 % 50).alias("number"), (F.col("o_orderkey") % 5 != 0).alias("verified"))
    return reports.unreplayed(rows, "o_custkey", "number", ["o_orderkey"], "verified").select("o_orderkey", "accepted")


REPLAY_SQL = """WITH r AS (SELECT o_orderkey, o_custkey, o_orderkey * 7919 % 50 AS number, o_orderkey % 5 <> 0 AS ok FROM orders)
SELECT o_orderkey, ok AND coalesce(number > max(number) FILTER (WHERE ok) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM r"""


def _little(value):
    h = F.lpad(F.hex(value.cast("long")), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def kernel_records(spark, sf_dir):
    """Events written as binary records and read back; every ninth claims more bytes than it has."""
    data = F.col("event_type").cast("binary")
    claimed = F.octet_length(data) + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0)
    header = F.unhex(F.concat(_little(F.col("user_id")), _little(F.col("event_id") % 2 + 1), _little(claimed), _little(F.col("event_id") % 4)))
    rows = assemble.decode_records(table(spark, sf_dir, "events").select("event_id", F.concat(header, data).alias("record")))
    return rows.select("event_id", "tgid", "fd", "flags", F.col("data").cast("string").alias("data"))


RECORDS_SQL = "SELECT event_id, CASE WHEN ok THEN user_id END AS tgid, CASE WHEN ok THEN event_id % 2 + 1 END AS fd, CASE WHEN ok THEN event_id % 4 END AS flags, CASE WHEN ok THEN event_type END AS data FROM (SELECT *, event_id % 9 <> 0 AS ok FROM events)"


def record_outcomes(spark, sf_dir):
    writes = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("flags"))
    return writes.groupBy(assemble.outcome(F.col("flags")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def adaptive_threshold(spark, sf_dir):
    """The threshold that the first 100 values of the events give, and that fewer samples would not."""
    events = table(spark, sf_dir, "events")
    both = native.adaptive_threshold(events, ["ts", "event_id"], "value", 3.6).unionByName(native.adaptive_threshold(events.filter("event_id < 5"), ["ts", "event_id"], "value", 3.6))
    return both.select(F.round("threshold", 6).alias("threshold"), "ready")


ADAPTIVE_SQL = "SELECT round(avg(value) + 2 * stddev_pop(value), 6)::DOUBLE AS threshold, true AS ready FROM (SELECT value FROM events ORDER BY ts, event_id LIMIT 100) UNION ALL SELECT 3.6::DOUBLE, false"


def complexity_scores(spark, sf_dir):
    return detect._words(spark, sf_dir).select("word", F.round(native.complexity(F.col("word")), 6).alias("score"))


COMPLEXITY_SQL = f"SELECT word, round(bits + bonus + adjustment, 6)::DOUBLE AS score FROM ({detect.SHANNON_SQL}) JOIN ({detect.CLASSES_SQL}) USING (word) JOIN ({detect.BIGRAM_SQL}) USING (word)"


def written_cards(spark, sf_dir):
    """Card numbers of 16 digits out of documents, written with blanks or dashes into a sentence, and found again."""
    cards = detect.cards(spark, sf_dir).filter("length(card) = 16").select("doc_id", "card")
    groups = [F.substring("card", i, 4) for i in (1, 5, 9, 13)]
    text = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", *groups)).otherwise(F.concat_ws("-", *groups))
    sentence = F.concat(F.lit("paid by "), text, F.lit(", ref 12-34 1234 5678 9012 3456"))
    return cards.select("doc_id", F.explode(native.written_cards(sentence)).alias("card"))


#: Numbers of the North American plan in every written form, by arithmetic over customers; most of some forms are none.
FORMS = {"paren": "'(' || a || ') ' || b || '-' || c", "tight": "'(' || a || ')' || b || '.' || c", "dash": "a || '-' || b || '-' || c", "dot": "a || '.' || b || '.' || c", "mixed": "a || '-' || b || '.' || c", "glued": "'x' || a || '-' || b || '-' || c", "long": "a || '-' || b || '-' || c || '9'"}


def written_phones(spark, sf_dir):
    k = F.col("c_custkey")
    parts = table(spark, sf_dir, "customer").select("c_custkey", F.lpad((k * 37 % 1000).cast("string"), 3, "0").alias("a"), F.lpad((k * 91 % 1000).cast("string"), 3, "0").alias("b"), F.lpad((k * 7 % 10000).cast("string"), 4, "0").alias("c"))
    forms = F.array(*[F.struct(F.lit(n).alias("form"), F.expr(f"'call ' || {e} || ' now'").alias("text")) for n, e in FORMS.items()])
    rows = parts.select("c_custkey", F.inline(forms))
    return rows.select("c_custkey", "form", F.size(native.written_phones(F.col("text"))).alias("n"))


PHONES_SQL = "WITH p AS (SELECT c_custkey, c_custkey * 37 % 1000 >= 200 AND c_custkey * 91 % 1000 >= 200 AS ok FROM customer) " + " UNION ALL ".join(f"SELECT c_custkey, '{n}' AS form, {'0' if n in ('mixed', 'glued', 'long') else 'CASE WHEN ok THEN 1 ELSE 0 END'} AS n FROM p" for n in FORMS)


def births(spark, sf_dir):
    """Dates under keys of birth and others: which are hidden. The days go round within years of birth, 1950 to 2097."""
    day = F.date_add(F.lit("1950-01-01").cast("date"), F.pmod(F.col("c_custkey") * 17, F.lit(54_000)).cast("int"))
    pairs = F.array(*[F.struct(F.lit(key).alias("key"), F.date_format(day, form).alias("value")) for key, form in BIRTHS])
    people = table(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)  # the table is read in too few parts
    rows = people.select("c_custkey", F.inline(pairs)).withColumn("kind", native.key_kind(native.key_words(F.col("key"))))
    return rows.select("c_custkey", "key", native.keyed_value(F.col("kind"), F.col("value")).alias("hidden"))


BIRTHS = [("dob", "yyyy-MM-dd"), ("birthDate", "dd/MM/yyyy"), ("date_of_birth", "d.M.yyyy"), ("created", "yyyy-MM-dd"), ("birthday", "yyMMdd"), ("birth_place", "yyyy-MM-dd"), ("born", "yyyy/M/d")]
BIRTHS_SQL = " UNION ALL ".join(f"SELECT c_custkey, '{k}' AS key, {str(k in ('dob', 'birthDate', 'date_of_birth', 'born')).lower()} AS hidden FROM customer" for k, _ in BIRTHS)

QUERIES = {
    "target_down": (target_down, DOWN_SQL),
    "error_rate": (error_rate, RATE_SQL),
    "latency_quantiles": (latency_quantiles, QUANTILES_SQL),
    "no_throughput": (no_throughput, THROUGHPUT_SQL),
    "day_findings": (day_findings, DAY_SQL),
    "threshold_alerts": (threshold_alerts, THRESHOLD_SQL),
    "set_reports": (set_reports, SET_SQL),
    "token_owners": (token_owners, "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "publication_versions": (publication_versions, "SELECT o_orderkey, c_custkey, c_name AS revision FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey DESC"),
    "running_pods": (running_pods, "SELECT s_name, s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_name"),
    "pods_by_revision": (pods_by_revision, PODS_SQL),
    "summed_maps": (summed_maps, MAPS_SQL),
    "detector_scores": (detector_scores, SCORES_SQL),
    "policy_counts": (policy_counts, POLICY_SQL),
    "received_reports": (received_reports, RECEIVED_SQL),
    "replayed_statements": (replayed_statements, REPLAY_SQL),
    "kernel_records": (kernel_records, RECORDS_SQL),
    "record_outcomes": (record_outcomes, "SELECT CASE WHEN event_id % 4 = 0 THEN 'ok' ELSE 'truncated' END AS outcome, count(*) AS n FROM events GROUP BY 1"),
    "adaptive_threshold": (adaptive_threshold, ADAPTIVE_SQL),
    "complexity_scores": (complexity_scores, COMPLEXITY_SQL),
    "written_cards": (written_cards, f"WITH {detect.CARDS} SELECT doc_id, card FROM cards WHERE length(card) = 16"),
    "written_phones": (written_phones, PHONES_SQL),
    "births": (births, BIRTHS_SQL),
}
