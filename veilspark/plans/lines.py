"""Queries of the scanner over derived lines, each with SQL that states the result from the rules.

A template is a line with {v} for a value that differs from row to row; the SQL puts the value's keyed
mark, computed by SQL, in its place - or leaves the line as it is - and says where the value stood.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Rule, ScanConfig
from ..operators import redact
from .detect import SALT, table, tag_sql

#: Values, as expressions in either dialect over c_custkey and c_name ({s}: the dialect's text type).
VALUES = {
    "word": "'hunter' || CAST(c_custkey AS {s})",
    "random": "'Zq' || upper(substr(md5(c_name), 1, 8)) || substr(md5(c_name), 9, 8) || 'x7K'",
    "aws": "'AKIA' || upper(substr(md5(c_name), 1, 16))",
    "github": "'ghp_' || md5(c_name) || '0000'",
    "slack": "'xoxb-' || md5(c_name)",
    "telegram": "CAST(100000 + c_custkey AS {s}) || ':A' || substr(md5(c_name), 1, 32) || 'zz'",
    "mail": "'user' || CAST(c_custkey AS {s}) || '@mail.example.com'",
    "mrn": "CAST(100000 + c_custkey AS {s})",
    "code": "CAST(1000 + c_custkey AS {s})",
    "session": "CAST(1000000000 + c_custkey AS {s})",
    "phone": "'+49 170 ' || CAST(1000000 + c_custkey AS {s})",
    "nanp": "'(415) 555-' || CAST(1000 + c_custkey % 9000 AS {s})",
    "keyed_phone": "CAST(5550000 + c_custkey AS {s})",
    "birth": "CAST(1950 + c_custkey % 50 AS {s}) || '-0' || CAST(1 + c_custkey % 9 AS {s}) || '-1' || CAST(c_custkey % 10 AS {s})",
    "uuid": "substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12)",
    "git": "md5(c_name) || substr(md5(c_name), 1, 8)",
    "short_hash": "substr(md5(c_name), 1, 12)",
    "stamp": "'2026-01-30T00:00:0' || CAST(c_custkey % 10 AS {s}) || 'Z'",
    "rule": "'TX-' || CAST(10000 + c_custkey AS {s})",
    "basic": "'dXNlcjpw' || substr(md5(c_name), 1, 12) || 'QQ=='",
    "phrase": "'user=admin pass' || CAST(c_custkey AS {s})",
    "credential": "'Bearer Zq' || md5(c_name)",
    "pem": "'-----BEGIN RSA PRIVATE KEY-----'",
}
CONFIG = ScanConfig(salt=SALT, custom_regexes=(Rule(r"TX-\d{5}", "TX"),), safe_regexes=(Rule(r"^safe_.*"),))

#: Tasks a core that a table's lines are dealt over.
TASKS = 4

#: Groups of templates: (name, line, value, label, strategy); no label: the line stays.
GROUPS = {
    "scan_pairs": [
        ("equals", "user login password={v} ok", "word", "key", "key"), ("colon", "password: {v} next", "word", "key", "key"), ("json", '{"user": "bob", "password": "{v}"}', "word", "key", "key"),
        ("compact", '{"user":"bob","token":"{v}"}', "word", "key", "key"), ("python", "{'secret': '{v}'}", "word", "key", "key"), ("quoted", 'secret="{v}" end', "word", "key", "key"),
        ("whole_phrase", '{"secret": "{v}"}', "phrase", "key", "key"), ("named", '{"name": "DB_PASSWORD", "value": "{v}"}', "word", "key", "key"), ("copula", "the password is {v} now", "word", "key", "key"),
        ("bare", "use key {v} x", "random", "key", "key"), ("nested", "data=password={v} x", "word", "key", "key"), ("pub_key", "public_key={v}", "code", None, None), ("tokens_used", "prompt_tokens={v}", "code", None, None),
        ("pw_part", "db_pw={v}", "word", "key", "key"), ("level", "INFO:app.main:password={v}", "word", "key", "key"), ("literal", '{"password": null, "id": "{v}"}', "code", None, None), ("other_key", "color={v}", "code", None, None),
        ("chain", "a=1&password={v}&b=2", "word", "key", "key"), ("full_width", "密码：{v}", "word", "key", "key"), ("email_key", "mail={v}", "mail", "email", "signature"),
    ],
    "scan_schemes": [
        ("bearer", "Authorization: Bearer {v}", "random", "key", "key"), ("basic", "Authorization: Basic {v}", "basic", "key", "key"), ("bearer_json", '{"authorization": "{v}"}', "credential", "key", "key"), ("prose", "the bearer of news {v}", "code", None, None),
    ],
    "scan_urls": [
        ("userinfo", "db postgres://app:{v}@db/app up", "word", "key", "key"), ("parameter", "GET /v1?token={v}&uid=123", "word", "key", "key"), ("inner", "see https://h.example/p?a=1&password={v}&b=2 ok", "word", "key", "key"),
        ("address", "GET /v1?user={v}&b=2", "mail", "email", "signature"), ("random", "GET /v1?x={v}&b=2", "random", "url", "entropy"), ("bot_path", "https://api.example/bot{v}/send", "telegram", "telegram-bot-token", "signature"),
        ("path", "https://h.example/a/{v}/x", "git", None, None), ("plain", "https://h.example/a/{v}", "code", None, None), ("uuid", "GET /v1?id={v}", "uuid", None, None), ("phone", "GET /v1?phone={v}", "keyed_phone", "phone", "signature"),
    ],
    "scan_numbers": [
        ("phone", "call {v} now", "phone", "phone", "signature"), ("nanp", "fax {v} x", "nanp", "phone", "signature"), ("keyed_phone", "phoneNumber={v}", "keyed_phone", "phone", "signature"), ("no_phone_key", "count={v}", "keyed_phone", None, None),
        ("mrn", "mrn={v} order_id=7", "mrn", "id-number", "signature"), ("order", "order_id={v}", "mrn", None, None), ("otp", "otp_code: {v} status", "code", "key", "signature"), ("status", "status_code: {v}", "code", None, None),
        ("dob", '"dob": "{v}", "n": 1', "birth", "dob", "signature"), ("created", '"created": "{v}"', "birth", None, None), ("session", "PHPSESSID={v}", "session", "key", "signature"), ("unix", "at {v} x", "session", None, None),
    ],
    "scan_tokens": [
        ("aws", "deploy {v} rotated", "aws", "aws-key", "signature"), ("aws_key_half", "{v}=x", "aws", "aws-key", "signature"), ("github", "push with {v}, ok", "github", "github-token", "signature"), ("slack", "hook {v}", "slack", "slack-token", "signature"),
        ("telegram", "bot {v} up", "telegram", "telegram-bot-token", "signature"), ("mail", "mail {v}, ok", "mail", "email", "signature"), ("mail_end", "write to {v}.", "mail", "email", "signature"), ("random", "ref {v} tail", "random", "entropy", "entropy"),
        ("context", "error {v} tail", "random", "context", "entropy"), ("rule", "order {v} shipped", "rule", "TX", "regex"), ("safe_rule", "x safe_{v} y", "random", None, None), ("uuid", "id {v} x", "uuid", None, None), ("git", "at {v} x", "git", None, None),
        ("commit", "commit={v} x", "short_hash", None, None), ("stamp", "at {v} done", "stamp", None, None), ("mark", "a [HIDDEN:abc123] {v}", "code", None, None),
    ],
    "scan_wrappers": [
        ("escaped_json", '{"data": "{\\"password\\": \\"{v}\\", \\"user\\": \\"bob\\"}"}', "word", "key", "key"), ("escaped_text", '{"m": "said \\"my pass is {v}\\""}', "word", "key", "key"), ("backtick", "run `password={v}` x", "word", "key", "key"),
        ("diff_plus", "+password={v}", "word", "key", "key"), ("diff_header", "rename to {v}", "random", None, None), ("bytes", "b'password={v}'", "word", "key", "key"), ("pem", "{v}", "pem", "private-key", "signature"), ("quoted_phrase", 'msg "token={v} sent"', "word", "key", "key"),
        ("apostrophe", "don't use password={v} here", "word", "key", "key"),
    ],
}


def _lines(spark, sf_dir, group: str):
    """Lines of each template, dealt evenly over tasks: the scanner takes far longer than the few bytes that a
    customer is read from, so the parts that a table is read in are too few."""
    each = F.array(*[
        F.struct(F.lit(name).alias("template"), F.replace(F.lit(line), F.lit("{v}"), F.expr(VALUES[value].replace("{s}", "STRING"))).alias("line")) for name, line, value, _, _ in GROUPS[group]
    ])
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(TASKS * spark.sparkContext.defaultParallelism)
    return rows.select("c_custkey", F.inline(each))


def _scanned(group: str):
    def query(spark, sf_dir):
        out = redact.redact(_lines(spark, sf_dir, group), "line", CONFIG)
        one = F.get("findings", 0)
        return out.select("c_custkey", "template", F.col("line").alias("redacted"), F.size("findings").alias("n"), one["label"].alias("label"), one["strategy"].alias("strategy"), one["start"].alias("start"))

    return query


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql(group: str) -> str:
    parts = []
    for name, line, value, label, strategy in GROUPS[group]:
        v = VALUES[value].replace("{s}", "VARCHAR")
        before, after = line.split("{v}")
        named = "TX:" if strategy == "regex" else ""
        middle = f"'[HIDDEN:{named}' || {tag_sql('(' + v + ')')} || ']'" if label else v
        parts.append(f"SELECT c_custkey, {_text(name)} AS template, {_text(before)} || {middle} || {_text(after)} AS redacted, {int(bool(label))} AS n, {_text(label) if label else 'NULL'} AS label, {_text(strategy) if label else 'NULL'} AS strategy, {len(before) if label else 'NULL'}::INT AS start FROM customer")
    return " UNION ALL ".join(parts)


def line_findings(spark, sf_dir):
    """Findings of all derived lines as rows, by template: how many, and the sum of their places and lengths."""
    found = None
    for group in GROUPS:
        rows = _lines(spark, sf_dir, group).select("c_custkey", F.lit(group).alias("source"), "line")
        found = rows if found is None else found.unionByName(rows)
    spans = redact.spans(redact.redact(found, "line", CONFIG, audit=True), "source")
    return spans.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("length").alias("lengths"))


FINDINGS_SQL = "SELECT source, label, count(*) AS n, sum(start)::BIGINT AS starts, sum(len)::BIGINT AS lengths FROM (" + " UNION ALL ".join(
    f"SELECT '{group}' AS source, '{label}' AS label, {line.index('{v}')} AS start, length({VALUES[value].replace('{s}', 'VARCHAR')}) AS len FROM customer" for group, rows in GROUPS.items() for _, line, value, label, _ in rows if label
) + ") GROUP BY ALL"

def periodic_summary(spark, sf_dir):
    """Derived lines as a log of a line a second: lines, bytes, changed lines and findings by minute."""
    from ..streaming.assemble import summary

    rows = _lines(spark, sf_dir, "scan_pairs").select(F.timestamp_seconds(F.col("c_custkey") * 20).alias("at"), "line")
    return summary(redact.redact(rows, "line", CONFIG, audit=True), "at", "line").withColumn("from", F.unix_timestamp("from"))


SUMMARY_SQL = "WITH l AS (" + " UNION ALL ".join(
    f"SELECT c_custkey * 20 // 60 * 60 AS m, strlen({_text(line.split('{v}')[0])} || {VALUES[value].replace('{s}', 'VARCHAR')} || {_text(line.split('{v}')[1])}) AS b, {int(bool(label))} AS n FROM customer" for _, line, value, label, _ in GROUPS["scan_pairs"]
) + ") SELECT m AS \"from\", count(*) AS lines, sum(b)::BIGINT AS bytes, count(*) FILTER (WHERE n > 0) AS redacted, sum(n)::BIGINT AS findings, round(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 4)::DOUBLE AS percent FROM l GROUP BY m"


def report_windows(spark, sf_dir):
    """Events as growth samples: reports of five minutes and kind, as the streaming loop makes them."""
    from ..streaming.assemble import report_stream

    samples = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type", F.col("event_id").alias("lines"))
    return report_stream(samples, "at", ["event_type"], ["lines"]).select(F.unix_timestamp("from").alias("from_s"), F.unix_timestamp("to").alias("to_s"), "event_type", "samples", "lines")


WINDOWS_SQL = "SELECT (floor(epoch(ts) / 300) * 300)::BIGINT AS from_s, (floor(epoch(ts) / 300) * 300 + 300)::BIGINT AS to_s, event_type, count(*) AS samples, sum(event_id)::BIGINT AS lines FROM events GROUP BY 1, 2, 3"

QUERIES = {"periodic_summary": (periodic_summary, SUMMARY_SQL), "report_windows": (report_windows, WINDOWS_SQL), **{group: (_scanned(group), _sql(group)) for group in GROUPS}, "line_findings": (line_findings, FINDINGS_SQL)}
