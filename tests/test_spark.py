import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspark.config import ScanConfig
from veilspark.functions import native
from veilspark.operators import counters, redact
from veilspark.operators.scan import Scanner, key_kind
from veilspark.sources.lines import read_lines, stream_lines, write_lines
from veilspark.sources.metrics import parse_metrics
from veilspark.streaming import assemble

CONFIG = ScanConfig(salt="0123456789abcdef" * 2)
LIBRARY_SF = "/root/testdata/sf0.001"


def test_native_agrees_with_the_kernel(spark):
    s = Scanner(CONFIG)
    words = ["password", "aB3$x", "ааa", "request_id", "zzzz", "é1_Ab", "xkcdQ9", "token", "A"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.round(native.complexity(F.col("w")), 9).alias("c"), native.hmac_tag(F.col("w"), CONFIG.salt).alias("t")).collect()
    for r in rows:
        assert r.c == pytest.approx(s.complexity(r.w), abs=1e-8)
        assert s.hide(r.w, "", "entropy") == f"[HIDDEN:{r.t}]"
    keys = ["phoneNumber", "contact", "contactNo", "wa_id", "ssn", "order_id_no", "id_no", "national_id", "otp", "mfaCode", "statusCode", "one_time_code", "PHPSESSID", "session_id", "dateOfBirth", "birth_date", "x" * 70, "a_b_c_d_e_f_g_h_ssn", ""]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", native.key_kind(native.key_words(F.col("k"))).alias("v")).collect()
    assert [r.v or "" for r in got] == [key_kind(k) for k in keys]


def test_redact_and_audit(spark):
    df = spark.createDataFrame([(1, "password=hunter22"), (2, None), (3, "plain words"), (4, "")], "id int, text string").withColumn("error", F.lit("clash"))
    got = {r.id: r for r in redact.redact(df, "text", CONFIG).collect()}
    assert got[1].text.startswith("password=[HIDDEN:") and got[1].would_redact and got[2].text is None and got[3].text == "plain words" and got[4].text == ""
    assert [(f.strategy, f.label) for f in got[1].findings] == [("key", "key")] and got[1].error is None
    audit = {r.id: r for r in redact.redact(df, "text", CONFIG, audit=True).collect()}
    assert audit[1].text == "password=hunter22" and audit[1].would_redact
    redact.register(spark, CONFIG)
    assert spark.sql("select scan('token: abc123def').redacted").first()[0].startswith("token: [HIDDEN:")
    changed = redact.preview(df, "text", CONFIG, ScanConfig(salt=CONFIG.salt, sensitive_keys=("plain",))).filter("changed").select("id").collect()
    assert [r.id for r in changed] == [1]


def test_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(b"one\r\ntwo\rstill two\nlast")
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "in")).collect()) == ["last", "one", "two\rstill two"]
    write_lines(read_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert read_lines(spark, str(tmp_path / "out")).count() == 3


def test_stream_is_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("password=hunter22\nplain\n")
    seen = []
    q = assemble.redact_stream(stream_lines(spark, str(tmp_path / "in")), lambda: CONFIG, lambda df, n: seen.extend(r.value for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(seen) == sorted(r.value for r in redact.redact(read_lines(spark, str(tmp_path / "in")), "value", CONFIG).collect())


def test_assembly(spark):
    rows = [(1, 1, 1, b"ab\ncd"), (1, 1, 2, b"x"), (1, 1, 3, b"ef\n"), (1, 2, 4, b"tail"), (2, 1, 5, b"\n\nq\n"), (2, 1, 6, b"")]
    got = assemble.assemble(spark.createDataFrame(rows, "tgid int, fd int, seq long, data binary")).collect()
    assert sorted((r.tgid, r.fd, r.line_no, r.line) for r in got) == [(1, 1, 0, "ab"), (1, 1, 1, "cdxef"), (1, 2, 0, "tail"), (2, 1, 0, ""), (2, 1, 1, ""), (2, 1, 2, "q")]
    assert assemble.cut(b"a", b"b\nc", 10) == ([(b"ab", False)], b"c")
    assert assemble.cut(b"", b"x" * 25, 10) == ([(b"x" * 25, True)], b"")


def test_assembly_of_a_stream(spark, tmp_path):
    schema = "tgid int, fd int, seq long, data binary"
    rows = [(1, 1, 1, b"ab\ncd"), (1, 1, 2, b"x"), (1, 1, 3, b"ef\n"), (1, 2, 4, b"tail"), (2, 1, 5, b"q\n")]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = []
    q = assemble.assemble_stream(stream, idle_ms=600_000).writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((t, f, line) for t, f, _, line, over in seen) == [(1, 1, "ab"), (1, 1, "cdxef"), (2, 1, "q")]


def test_counters(spark):
    rows = [("a", 1, 100.0), ("a", 2, 120.0), ("a", 3, 130.0), ("b", 1, 50.0), ("b", 2, 7.0)]
    got = counters.growth(spark.createDataFrame(rows, "pod string, at int, v double"), "pod", ["at"], "v").agg(F.sum("growth")).first()[0]
    assert got == 37


def test_metrics(spark):
    lines = ['a_total{x="1\\"\\\\n",y="\\n"} 3', "b 4.5 1700000000", "# HELP a", "c NaN", "d -1", "e{ 2", "f +Inf", ""]
    got = {r.series: (r.labels, r.value) for r in parse_metrics(spark.createDataFrame([(x,) for x in lines], "l string"), "l").collect()}
    assert got == {"a_total": ({"x": '1"\\n', "y": "\n"}, 3.0), "b": ({}, 4.5)}


def test_diff_lines(spark):
    from veilspark.operators.policies import DiffLines

    got = [(r.op, r.line) for r in DiffLines(F.lit("a\nb\nc"), F.lit("a\nx\nc\nd")).collect()]
    assert got == [(" ", "a"), ("+", "x"), ("-", "b"), (" ", "c"), ("+", "d")]


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["lang", "source", "strategy", "label", "n"]


@pytest.mark.parametrize("name", sorted(entry.LIBRARY))
def test_queries_run(spark, name):
    df = entry.queries()[name](spark, LIBRARY_SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_oracles_agree(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(LIBRARY_SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{LIBRARY_SF}/{t}')")
    from veilspark.plans import lines, reports

    for name in ("card_tags", "emails", "bigram_scores", "counter_growth", "alerts", "assemble_lines", *reports.QUERIES, *lines.QUERIES):
        df = entry.queries()[name](spark, LIBRARY_SF)
        rel = con.sql(entry.oracle_sql()[name])
        at = [rel.columns.index(c) for c in df.columns]
        plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
        assert sorted([tuple(map(plain, r)) for r in df.collect()], key=str) == sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=str), name


def test_scanner_queries_are_the_scanner(spark):
    """The queries that no SQL expresses, against the scanner called row by row."""
    import collections
    import hashlib

    import pyarrow.parquet as pq

    from veilspark.plans import kernel

    scanner = Scanner(kernel.CONFIG)
    want = collections.Counter()
    for r in pq.read_table(f"{LIBRARY_SF}/documents.parquet").to_pylist():
        want.update((r["lang"], r["source"], f.strategy, f.label) for f in scanner.scan(r["text"] or "")[1])
    assert {(r.lang, r.source, r.strategy, r.label): r.n for r in kernel.scan_documents(spark, LIBRARY_SF).collect()} == want
    got = {(r.conv_id, r.turn): (r.text_md5, r.would_redact, r.error) for r in kernel.redact_conversations(spark, LIBRARY_SF).collect()}
    for r in pq.read_table(f"{LIBRARY_SF}/conversations.parquet").to_pylist():
        out, found, error = scanner.scan(r["text"]) if r["text"] is not None else (None, [], None)
        assert got[r["conv_id"], r["turn"]] == (None if out is None else hashlib.md5(out.encode()).hexdigest(), bool(found), error)
    draft = Scanner(ScanConfig(salt=kernel.CONFIG.salt, entropy_threshold=3.0))
    urls = {r["page_id"]: r["url"] for r in pq.read_table(f"{LIBRARY_SF}/pages.parquet").to_pylist()}
    for r in kernel.preview_rules(spark, LIBRARY_SF).collect():
        assert (r.published, r.draft) == (scanner.scan(urls[r.page_id])[0], draft.scan(urls[r.page_id])[0]) and r.changed == (r.published != r.draft)


def test_spans_in_sql(spark):
    redact.register(spark, CONFIG)
    got = spark.sql("select f.* from values ('password=hunter22\\nmail a@example.com'), (null) t(x), lateral redaction_spans(x) f").collect()
    assert [(r.label, r.line, r.start, r.length) for r in got] == [("key", 1, 9, 8), ("email", 2, 5, 13)]
    df = spark.createDataFrame([(1, "x\npassword=hunter22")], "id int, text string")
    assert [tuple(r) for r in redact.spans(redact.redact(df, "text", CONFIG), "id").collect()] == [(1, "key", "key", 2, 9, 8)]
    assert redact.spans(redact.redact(df.limit(0), "text", CONFIG), "id").count() == 0


def test_summary_of_a_stream(spark, tmp_path):
    from veilspark.streaming.assemble import summary

    rows = [(f"2026-01-01 00:0{m}:{s:02d}", line) for m in range(4) for s, line in ((1, "password=hunter22"), (30, "plain"))]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "at string, line string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02d}"))
    stream = spark.readStream.schema("at string, line string").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withColumn("at", F.to_timestamp("at"))
    seen = []
    q = summary(redact.redact(stream, "line", CONFIG, audit=True), "at", "line").writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["from"].minute, r.lines, r.redacted, r.findings, r.percent) for r in seen)[:2] == [(0, 2, 1, 1, 50.0), (1, 2, 1, 1, 50.0)]
