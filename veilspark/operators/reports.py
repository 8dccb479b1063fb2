"""Reports of clusters: receiving, joining, summing maps by key, scoring detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = "map<string, bigint>"
REPORT = f"schema string, cluster string, policy string, `from` timestamp_ntz, `to` timestamp_ntz, mode string, podsReporting bigint, podsTotal bigint, revisions {COUNTS}, lines bigint, errors bigint, redactions {COUNTS}, auditFindings {COUNTS}"
#: Most keys of a report's map, longest key and policy name.
KEYS, KEY, POLICY = 64, 128, 253


def receive(df: DataFrame, body: str, schema: str) -> DataFrame:
    """df with `report` (struct of REPORT) and `refused`, the first reason why a report isn't taken, or null."""
    r = F.from_json(body, REPORT)
    x = F.col("report")

    def bad_map(name: str) -> Column:
        return F.coalesce((F.size(x[name]) > KEYS) | F.exists(F.map_entries(x[name]), lambda e: (F.octet_length(e["key"]) > KEY) | (e["value"] < 0)), F.lit(False))

    zero = lambda name: F.coalesce(x[name], F.lit(0))
    reason = (
        F.when(x.isNull() | (F.coalesce(x["schema"], F.lit("")) != schema), "schema")
        .when((F.octet_length(F.coalesce(x["policy"], F.lit(""))) == 0) | (F.octet_length(x["policy"]) > POLICY) | (F.octet_length(F.coalesce(x["cluster"], F.lit(""))) > KEY), "names")
        .when(F.coalesce(~x["mode"].isin("redact", "audit"), F.lit(True)), "mode")
        .when(x["from"].isNull() | x["to"].isNull() | (x["to"] < x["from"]), "window")
        .when((zero("lines") < 0) | (zero("errors") < 0) | (zero("podsReporting") < 0) | (zero("podsTotal") < zero("podsReporting")), "counts")
        .when(bad_map("revisions") | bad_map("redactions") | bad_map("auditFindings"), "maps")
    )
    return df.withColumn("report", r).withColumn("refused", reason)


def map_sums(rows: DataFrame, by: list[str], maps: str) -> DataFrame:
    """by and the map of sums for each key over all rows' maps; groups without any key have an empty map.

    Keys are summed as rows before any map is built, so a group is never gathered row by row."""
    each = rows.select(*by, F.explode_outer(maps).alias("__key", "__n")).groupBy(*by, "__key").agg(F.sum("__n").alias("__n"))
    entries = F.array_sort(F.collect_list(F.when(F.col("__key").isNotNull(), F.struct("__key", "__n"))))
    return each.groupBy(*by).agg(F.map_from_entries(entries).alias(maps))


def counted(rows: DataFrame, by: list[str], key: str, out: str) -> DataFrame:
    """by and a map: how many rows have each value of `key` ('' for null)."""
    each = rows.groupBy(*by, F.coalesce(key, F.lit("")).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__key", "__n")))).alias(out))


def entries_text(m: Column) -> Column:
    """A map as text, `key=value` by key, for comparisons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def scores(rows: DataFrame, truth: Column, verdict: Column, *by: str) -> DataFrame:
    """by (rolled up), tp, fp, fn, tn, precision and recall (null where nothing was found or is true)."""
    flagged = rows.select(*by, F.coalesce(truth, F.lit(False)).alias("__t"), F.coalesce(verdict, F.lit(False)).alias("__v"))
    t, v = F.col("__t"), F.col("__v")
    sums = flagged.rollup(*by).agg(F.count_if(t & v).alias("tp"), F.count_if(~t & v).alias("fp"), F.count_if(t & ~v).alias("fn"), F.count_if(~t & ~v).alias("tn"), F.grouping_id().alias("level"))
    return sums.withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))})


def rule_counts(df: DataFrame, policy: str) -> DataFrame:
    """df with bytes and the number of each kind of rules of a policy document (JSON), 0 for absent ones,
    and valid: whether it is a JSON object with rules of the right form."""
    schema = "sensitive_keys array<string>, sensitive_key_patterns array<string>, custom_regexes array<struct<pattern:string,name:string>>, safe_regexes array<struct<pattern:string,name:string>>, entropy_threshold double, min_secret_length int"
    parsed = F.from_json(policy, schema, {"mode": "PERMISSIVE"})
    sizes = {f"n_{name}": F.coalesce(F.size(F.col("__policy")[name]), F.lit(0)) for name in ("sensitive_keys", "sensitive_key_patterns", "custom_regexes", "safe_regexes")}
    return df.withColumn("__policy", parsed).withColumns({"bytes": F.octet_length(policy), "valid": F.coalesce(F.json_object_keys(policy).isNotNull(), F.lit(False)), **sizes}).drop("__policy")


def unreplayed(statements: DataFrame, key: str, number: str, order: list[str], verified: str) -> DataFrame:
    """statements with `accepted`: verified, and numbered above every verified one of the key before it."""
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    highest = F.max(F.when(F.col(verified), F.col(number))).over(before)
    return statements.withColumn("accepted", F.col(verified) & (highest.isNull() | (F.col(number) > highest)))
