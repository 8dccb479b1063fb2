"""What a review of the queries found, on few rows: each query against its own SQL where its inputs outgrow the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_scan import SALT

import __spark_entry__ as entry
from veilspark.config import Rule, ScanConfig
from veilspark.functions import native
from veilspark.operators import policies
from veilspark.operators.scan import Scanner, needed
from veilspark.plans import lines


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables given as rows and schema, sorted."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, want))


def test_lines_are_dealt_over_tasks(spark, tmp_path):  # F1, F2
    spark.createDataFrame([(i, f"Customer#{i:09d}") for i in range(400)], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    parts = lines._lines(spark, str(tmp_path), "scan_pairs").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in parts) == 400 * len(lines.GROUPS["scan_pairs"])


@pytest.mark.parametrize(("rule", "want"), [("TX-\\d{5}", "TX-"), ("^safe_.*", "safe_"), ("ab*c", "a"), ("a?b", ""), ("ab{2}", "a"), ("a+b", "a"), ("x|y", ""), ("(?i)x", ""), ("[a]b", ""), ("\\d", ""), ("(a)b", "")])
def test_characters_that_a_rule_needs(rule, want):  # F1, F2
    assert needed(rule) == want


def test_rules_match_as_before():  # F1, F2
    scanner = Scanner(ScanConfig(salt=SALT, custom_regexes=(Rule("ab{2,}9", "A"), Rule("(?i)case1", "C")), safe_regexes=(Rule("^zz*9"),)))
    assert [bool(scanner.scan(x)[1]) for x in ("see xabb9 x", "see ab9 x", "see CASE1 x", "see xCase1y x")] == [True, False, True, True]
    assert scanner._matches(scanner.safe, "z9") and not scanner._matches(scanner.safe, "az9")


def test_births_of_many_customers(spark, tmp_path):  # F3
    keys = [0, 1, 3176, 3177, 4619, 15_000, 899_999, 200_000_000, 3_000_000_000]
    got, want = both(spark, tmp_path, "births", customer=([(k,) for k in keys], "c_custkey long"))
    assert got == want


def test_formatted_counts_of_many_parts(spark, tmp_path):  # F4
    got, want = both(spark, tmp_path, "formatted_counts", part=([(k,) for k in [0, 5, 6, 171_000, 172_400, 1_199_999, 40_000_000]], "p_partkey long"))
    assert got == want
    sizes = spark.range(1).select(policies.human_bytes(F.lit(5 * 1024**4)).alias("all"), policies.human_bytes(F.lit(5 * 1024**4), "KMG").alias("some")).first()
    assert tuple(sizes) == ("5.0 TB", "5120.0 GB")

#: Digits that a dash or point joins to a letter are no card, as in these UUIDs; the last lines hold one.
NO_CARDS = ["id 8763bd26-f0e0-620b-5514-206802119454 x", "x 45391488-0343-6467-abcd-abcdefabcdef", "ref é-4539148803436467", "at 4539148803436467.log", "a-4539148803436467"]
CARDS = ["card 4539148803436467.", "4539-1488-0343-6467, ok", "- 4539148803436467 -"]


@pytest.mark.parametrize("line", NO_CARDS + CARDS)
def test_cards_stand_alone(spark, line):  # F5, F6, F8
    want = int(line in CARDS)
    assert sum(f.label == "card" for f in Scanner(ScanConfig(salt=SALT)).scan(line)[1]) == want
    assert spark.createDataFrame([(line,)], "t string").select(F.size(native.written_cards(F.col("t")))).first()[0] == want


def customer_4214():
    return [(4214, "Customer#000004214")], "c_custkey long, c_name string"


def test_scan_tokens_uuid_like_a_card(spark, tmp_path):  # F5
    got, want = both(spark, tmp_path, "scan_tokens", customer=customer_4214())
    assert got == want


def test_line_findings_uuid_like_a_card(spark, tmp_path):  # F6
    got, want = both(spark, tmp_path, "line_findings", customer=customer_4214())
    assert got == want


def test_phones_end_where_they_end(spark, tmp_path):  # F7
    texts = ["call +1 (843) 555-7672 170 units", "x+1 (843) 555-7672", "+1 (843) 555-76721", "=+49 (843) 555-7672a", "+1 (843) 555-7672 +1 (826) 555-4081", "+0 (843) 555-7672 +1234 (843) 555-7672", "+1 843 555 7672", "+", "", None]
    got, want = both(spark, tmp_path, "phones", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert got == want and len(got) == 6


def test_scan_urls_uuid_like_a_card(spark, tmp_path):  # F8
    got, want = both(spark, tmp_path, "scan_urls", customer=customer_4214())
    assert got == want
