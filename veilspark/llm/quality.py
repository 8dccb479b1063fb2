"""Operator 8: quality rules whose cutoffs have a controlled risk, with DataFrame functions only.

Each rule is a ratio of a text that is large for bad texts, with a fixed grid of cutoffs from lax to
strict. The labelled good documents choose and prove the cutoffs, in parts that share no document:

1. A quarter of them (by a hash of the id) proposes. For each stratum and each of `LEVELS`, a rule's
   cutoff is the strictest that rejects at most the level's share of the quarter, and so many grid
   points laxer as the level says; the rule stays off unless the quarter's bad documents are rejected
   there more often than its good ones (if it has bad ones). Levels ascend from lax to strict.
2. The other three quarters prove. For each level, in order, an exact binomial test asks whether all
   rules together reject less than `ALPHA` of the stratum's good documents, at level DELTA / strata
   (Bonferroni over the strata). The first level that isn't proven ends the sequence, so testing
   further levels costs no error (fixed-sequence testing). The last proven level holds; without one
   the rules are off in the stratum.

So with probability 1 - DELTA, the rules reject at most ALPHA of the good documents in every stratum.
Strata are classes of text length: few and fixed, so none is a hot key and every table of cutoffs is
bounded. Neighbouring classes are merged until each has `NEED` proving documents (their number alone
decides, never an outcome), so that few labels still can prove something.

Good: every label of the document has quality 1; bad: one has quality 0. Null text: no words, so the base rules reject it.
Null ids never meet a label. Repeated rows are judged alike; repeated labels count once. Without
labels all rules are off and the base rules alone decide. An empty table gives an empty result.
Columns that clash with the output's are left out of `judge`; `admit` keeps all of docs' own. Very long
texts are judged whole, within one row.

Windows of eight words are compared by 64-bit hashes within one text: among n windows, two different
ones are taken as equal with a chance of n^2 / 2^65, 10^-8 for a million words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, materialize, whole_text

WINDOW = 8
#: Upper bounds of the word counts of the classes of length, the last open.
STRATA = (50, 150, 500, 2000)
GRID = {
    "symbols": [0.32, 0.16, 0.08, 0.04, 0.02, 0.01, 0.005],
    "dup_lines": [0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "repeats": [0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02],
    "long_words": [20.0, 15.0, 12.0, 10.0, 8.0, 7.0, 6.5, 6.0],
    "short_words": [-2.0, -2.5, -3.0, -3.5, -4.0, -4.25, -4.5],
}
#: Grid points by which a level is laxer than what the proposing part allows, and the share that a rule may reject there.
LEVELS = [(2, 0.0), (1, 0.0), (0, 0.0), (0, 0.002), (0, 0.004)]
ALPHA, DELTA, NEED = 0.02, 0.05, 250
#: First digits of the id's hash of the documents that propose.
PROPOSE = ("0", "1", "2", "3")


def base_columns(docs: DataFrame, *keep: str) -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of whole texts."""
    text = whole_text()
    words = F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    step = docs.select(*keep, text.alias("__text"), F.transform(words, lambda w: F.xxhash64(w)).alias("__words"), lines.alias("__lines"))
    step = step.withColumn("__n", F.size("__words"))
    last = F.greatest(F.col("__n") - WINDOW, F.lit(-1))
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice("__words", i + 1, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("__windows", windows)
    # Only texts with some window twice are sorted by (hash, place) to find the places.
    place = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), place))
    def twice(x: Column, i: Column) -> Column:
        return F.coalesce(F.get("__sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__sorted", i + 1)["h"] == x["h"], F.lit(False))
    step = step.withColumn("__twice", F.when(F.col("__sorted").isNotNull(), F.sort_array(F.transform(F.filter("__sorted", twice), lambda x: x["i"]))))
    covered = F.aggregate("__twice", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end")), lambda a, i: F.struct(
        (a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("long").alias("n"), (i + WINDOW).alias("end")))["n"]
    return step.select(
        *keep, F.col("__n").cast("long").alias("n_words"),
        F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("__lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """One value for each rule, larger for worse texts; zero where there are no words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars, "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words, "short_words": -F.col("word_chars") / words,
    }


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") < STRATA[i], i).otherwise(out)
    return out


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Exact P(X <= k) for X of Binomial(n, p), summed from the top term down in logarithms' scale.

    The term of k is built by a product in logs; the terms below it follow by their ratios, so
    nothing underflows that matters and the sum has at most k + 1 terms."""
    up = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, j: a + F.when(k > 0, F.log((n - j + 1) / j)).otherwise(0.0))
    top = up + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    def step(a: Column, j: Column) -> Column:  # from the term of i = k - j + 1 to that of i - 1
        i = k - j + 1
        term = a["term"] * i / (n - i + 1) * odds
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))
    ratio = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda a, j: F.when(k > 0, step(a, j)).otherwise(a))["sum"]
    return F.least(F.lit(1.0), F.exp(top + F.log(ratio)))


def judged_ids(labels: DataFrame) -> DataFrame:
    """__id and __good of the documents that some label judges."""
    return labels.groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") == 1).alias("__good")).filter("__good is not null")


def merged_strata(proving: DataFrame, need: int) -> DataFrame:
    """class, stratum (its first class) and strata (how many there are): one row a class of length."""
    last = len(STRATA)
    row = proving.agg(*[F.count_if(F.col("class") == i).alias(f"n{i}") for i in range(last + 1)]).withColumns({"s0": F.col("n0"), "f0": F.lit(0)})
    for i in range(1, last + 1):
        full = F.col(f"s{i - 1}") >= need
        row = row.withColumns({f"s{i}": F.when(full, F.col(f"n{i}")).otherwise(F.col(f"s{i - 1}") + F.col(f"n{i}")), f"f{i}": F.when(full, i).otherwise(F.col(f"f{i - 1}"))})
    # a last stratum that is too small joins the one before it
    joined = F.when((F.col(f"s{last}") < need) & (F.col(f"f{last}") > 0), F.element_at(F.array(*[f"f{i}" for i in range(last + 1)]), F.greatest(F.col(f"f{last}"), F.lit(1)))).otherwise(F.col(f"f{last}"))
    row = row.withColumn("all", F.array(*[F.when(F.col(f"f{i}") == F.col(f"f{last}"), joined).otherwise(F.col(f"f{i}")) for i in range(last + 1)]))
    return row.select(F.posexplode("all").alias("class", "stratum"), F.size(F.array_distinct("all")).alias("strata"))


def proposed(proposing: DataFrame, rules: list[str]) -> DataFrame:
    """stratum, level and a cutoff for each rule (null: off)."""
    # a document exceeds the last points of a grid, from lax to strict: the first of them says all
    def first(rule: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, GRID[rule])), lambda c: F.col(rule) <= c))

    each = [F.struct(F.lit(r).alias("rule"), first(r).alias("first")) for r in rules]
    points = max(map(len, GRID.values()))
    counted = proposing.select("stratum", "__good", F.inline(F.array(*each))).groupBy("stratum", "rule", "__good", "first").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(counted, "firsts").groupBy("stratum", "rule").agg(*[
        F.array(*[F.coalesce(F.sum(F.when((F.col("__good") == good) & (F.col("first") <= i), F.col("n"))), F.lit(0)) for i in (points, *range(points))]).alias(name) for name, good in (("good", True), ("bad", False))
    ])
    # good and bad: how many there are, then how many exceed each point
    grids = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for r in rules for x in (r, GRID[r])])
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(laxer).alias("laxer"), F.lit(float(share)).alias("share")) for i, (laxer, share) in enumerate(LEVELS)]))
    rows = rows.filter(F.col("good")[0] > 0).withColumn("grid", grids[F.col("rule")]).withColumn("l", levels)
    fits = F.filter(F.sequence(F.lit(0), F.size("grid") - 1), lambda i: F.get("good", i + 1) <= F.col("good")[0] * F.col("l.share"))
    at = F.coalesce(F.array_max(fits), F.lit(-1)) - F.col("l.laxer")
    rows = rows.withColumn("at", at)
    useful = (F.col("bad")[0] == 0) | (F.get("bad", F.col("at") + 1) * F.col("good")[0] > F.get("good", F.col("at") + 1) * F.col("bad")[0])
    cut = F.when((F.col("at") >= 0) & useful, F.get("grid", F.col("at")))
    return rows.groupBy("stratum", F.col("l.level").alias("level")).agg(*[F.max(F.when(F.col("rule") == r, cut)).alias(r) for r in rules])


def cutoffs(base: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, need: int = NEED) -> DataFrame:
    """class and, for each rule, the proven cutoff or null: at most one row a class of length.
    base: base_columns with doc_id, written before: predicates would carry their computation along."""
    rules = list(GRID)
    fine = base.filter(~base_failed()).join(judged_ids(labels), F.col("doc_id") == F.col("__id"))
    part = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin(*PROPOSE)
    # each step is written: a few numbers a labelled document, then a few rows; so plans stay small
    held = materialize(fine.select("__good", part.alias("proposes"), stratum().alias("class"), *[v.alias(r) for r, v in rule_values().items()]), "held")
    strata = F.broadcast(materialize(merged_strata(held.filter("__good and not proposes"), need), "strata"))
    placed = held.join(strata, "class")
    paths = materialize(proposed(placed.filter("proposes"), rules), "paths")
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(F.col(f"h.{r}") > F.col(f"p.{r}"), F.lit(False))
    met = placed.filter("__good and not proposes").alias("h").join(F.broadcast(paths).alias("p"), F.col("h.stratum") == F.col("p.stratum"))
    tested = met.groupBy(F.col("p.stratum").alias("stratum"), "level").agg(F.first("strata").alias("strata"), F.count(F.lit(1)).alias("n"), F.count_if(rejected).alias("k"))
    # a share of alpha or more never passes, so the sum of the tail stays short
    fails = F.when(F.col("k") >= F.col("n") * alpha, True).otherwise(binomial_tail(F.col("n"), F.least(F.col("k"), F.ceil(F.col("n") * alpha)), alpha) > delta / F.col("strata"))
    chosen = tested.groupBy("stratum").agg(F.coalesce(F.min(F.when(fails, F.col("level"))), F.lit(len(LEVELS))).alias("first_failure"))
    held_levels = chosen.join(paths, "stratum").filter(F.col("level") == F.col("first_failure") - 1)
    return materialize(held_levels.join(strata, "stratum").select("class", *rules), "cutoffs")


def _judged(base: DataFrame, chosen: DataFrame, rules: list[str]) -> DataFrame:
    """base with `rule`, the first that rejects, or null. chosen: a row a class of length at most."""
    named = chosen.select(F.col("class").alias("__class"), *[F.col(r).alias(f"__cut_{r}") for r in rules])
    met = base.withColumn("__c", stratum()).join(F.broadcast(named), F.col("__c") == F.col("__class"), "left")
    values = rule_values()
    return met.withColumn("rule", F.coalesce(F.when(base_failed(), "base"), *[F.when(values[r] > F.col(f"__cut_{r}"), r) for r in rules]))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, need: int = NEED) -> DataFrame:
    """doc_id, the base columns, base_failed, kept, and the first rule that rejects.

    The base columns - a few numbers a document - are written once and read for both steps."""
    base = materialize(base_columns(docs, "doc_id"), "quality")
    judged = _judged(base, cutoffs(base, labels, alpha, delta, need), list(GRID))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.col("rule").isNull().alias("kept"), "rule")


def admit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the rules reject; all columns stay as they are.

    Rows are written with their base columns, so these are computed once: the cutoffs read the
    columns of numbers alone."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    base = materialize(base_columns(rows, "doc_id", "__row"), "quality")
    return _judged(base, cutoffs(base.drop("__row"), labels), list(GRID)).filter("rule is null").select("__row.*")


def _oracle() -> str:
    classes = "CASE " + " ".join(f"WHEN n_words < {b} THEN {i}" for i, b in enumerate(STRATA)) + f" ELSE {len(STRATA)} END"
    values = {
        "symbols": "n_symbols / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
        "long_words": "word_chars / greatest(n_words, 1)", "short_words": "-word_chars / greatest(n_words, 1)",
    }
    last, rules = len(STRATA), list(GRID)
    sums = "m0 AS (SELECT *, n0 AS s0, 0 AS f0 FROM sizes)"
    for i in range(1, last + 1):
        sums += f",\nm{i} AS (SELECT *, CASE WHEN s{i - 1} >= {NEED} THEN n{i} ELSE s{i - 1} + n{i} END AS s{i}, CASE WHEN s{i - 1} >= {NEED} THEN {i} ELSE f{i - 1} END AS f{i} FROM m{i - 1})"
    heads = "[" + ", ".join(f"f{i}" for i in range(last + 1)) + "]"
    joined = f"CASE WHEN s{last} < {NEED} AND f{last} > 0 THEN {heads}[f{last}] ELSE f{last} END"
    merged = " UNION ALL ".join(f"SELECT {i} AS class, CASE WHEN f{i} = f{last} THEN {joined} ELSE f{i} END AS stratum FROM m{last}" for i in range(last + 1))
    points = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r in rules for i, c in enumerate(GRID[r]))
    levels = ", ".join(f"({i}, {laxer}, {share}::DOUBLE)" for i, (laxer, share) in enumerate(LEVELS))
    value = "CASE g.rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in rules) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT r, words, unnest(range(0, len(words) - {WINDOW - 1})) AS i FROM w WHERE len(words) >= {WINDOW}),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i + 1:i + {WINDOW}], ' ')) AS n FROM places),
repeats AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM windows WHERE n > 1) GROUP BY r),
base AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM w LEFT JOIN repeats USING (r)),
v AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {classes} AS class, {', '.join(f'{e} AS {r}' for r, e in values.items())} FROM base),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels GROUP BY doc_id HAVING min(quality) IS NOT NULL),
held AS (SELECT v.*, good, substr(md5(doc_id::VARCHAR), 1, 1) IN ({', '.join(f"'{x}'" for x in PROPOSE)}) AS proposes FROM v JOIN known USING (doc_id) WHERE NOT base_failed),
sizes AS (SELECT {', '.join(f'count(*) FILTER (WHERE class = {i}) AS n{i}' for i in range(last + 1))} FROM held WHERE good AND NOT proposes),
{sums},
strata AS ({merged}),
placed AS (SELECT held.*, stratum FROM held JOIN strata USING (class)),
g(rule, i, cutoff) AS (VALUES {points}),
counts AS (SELECT stratum, g.rule, g.i, g.cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS bad, count(*) FILTER (WHERE good AND {value} > g.cutoff) AS k, count(*) FILTER (WHERE NOT good AND {value} > g.cutoff) AS b FROM placed, g WHERE proposes GROUP BY ALL HAVING n > 0),
levels(level, laxer, share) AS (VALUES {levels}),
useful AS (SELECT stratum, rule, i, cutoff FROM counts WHERE bad = 0 OR b * n > k * bad),
strictest AS (SELECT stratum, rule, level, coalesce(max(i) FILTER (WHERE k <= n * share), -1) - laxer AS i FROM counts, levels GROUP BY stratum, rule, level, laxer),
paths AS (SELECT stratum, level, {', '.join(f"max(cutoff) FILTER (WHERE rule = '{r}') AS c_{r}" for r in rules)} FROM strictest LEFT JOIN useful USING (stratum, rule, i) GROUP BY stratum, level),
tested AS (SELECT stratum, level, count(*) AS n, count(*) FILTER (WHERE {' OR '.join(f'coalesce({r} > c_{r}, false)' for r in rules)}) AS k FROM placed JOIN paths USING (stratum) WHERE good AND NOT proposes GROUP BY ALL),
failed AS (SELECT stratum, coalesce(min(level) FILTER (WHERE k >= n * {ALPHA} OR list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) > {DELTA} / (SELECT count(DISTINCT stratum) FROM strata)), {len(LEVELS)}) AS first_failure FROM tested GROUP BY stratum),
chosen AS (SELECT class, paths.* FROM failed JOIN paths ON failed.stratum = paths.stratum AND level = first_failure - 1 JOIN strata ON strata.stratum = paths.stratum),
judged AS (SELECT v.*, CASE WHEN base_failed THEN 'base' {' '.join(f"WHEN {r} > c_{r} THEN '{r}'" for r in rules)} END AS rule FROM v LEFT JOIN chosen USING (class))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule IS NULL AS kept, rule FROM judged"""


ORACLE = _oracle()
