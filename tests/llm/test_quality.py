import math
import random
import re

from pyspark.sql import functions as F

from veilspark.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


def test_base_columns(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n ", "a b c d e f g h", "a b c d e f g h " * 3, "x\n\nx\n x\nx\r", "é\x0b🙂\x0c# $$ <|>", "a " * 30, "a\xa0b\x85c\x1cd"]
    texts += [" ".join(rnd.choices("abc", k=rnd.randint(5, 60))) + "\n" * rnd.randint(0, 2) for _ in range(40)] + ["w%d " * 3000 % tuple(range(3000))]
    texts += [" ".join(rnd.choices(["the quick brown fox jumps over the lazy dog", "one two", "z"], k=12)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for r in quality.base_columns(docs, "doc_id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 7, 100, 2000) for k in (0, 1, 5, 40) if k <= n for p in (0.002, 0.01, 0.3)]
    for p in (0.002, 0.01, 0.3):
        own = [(n, k) for n, k, q in cases if q == p]
        for r in spark.createDataFrame(own, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), p).alias("t")).collect():
            want = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
            assert math.isclose(r.t, min(1, want), rel_tol=1e-9), (r, p)


def test_cutoffs_and_verdicts(spark):
    rnd = random.Random(2)
    good = [(i, " ".join("w%d" % rnd.randrange(10**6) for _ in range(30))) for i in range(6000)]
    bad = [(10_000 + i, t + "".join(f" #${j}%&|<>" for j in range(15))) for i, (_, t) in enumerate(good[:300])] + [(20_000, None), (20_001, "short"), (None, good[0][1])]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string").withColumn("symbols", F.lit(9))
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:5000]] + [(0, 1), (None, 1), (10_000, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len(good + bad)
    assert all(got[i].kept for i, _ in good) and got[None].kept
    assert not any(got[i].kept for i, _ in bad if i) and got[10_001].rule == "symbols" and not got[10_001].base_failed
    assert got[20_000].base_failed and got[20_001].base_failed
    kept = quality.admit(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    none = quality.judge(docs, labels.limit(0))
    assert none.filter("kept = base_failed").count() == 0
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_thresholds_act_and_hold_on_other_labels(spark):
    """Half of the labels fit; on the other half few good documents are rejected and most bad ones are."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.xxhash64("doc_id") % 2 == 0
    base = quality.base_columns(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").cache()
    chosen = quality.cutoffs(base, labels.filter(half))
    got = quality._judged(base, chosen, list(quality.GRID)).filter("not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)").join(labels.filter(~half).groupBy("doc_id").agg(F.min("quality").alias("q")), "doc_id")
    by = {(r.s, r.q): (r.n, r.hit) for r in got.groupBy(quality.stratum().alias("s"), "q").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule").isNotNull()).alias("hit")).collect()}
    for s in range(5):
        n, hit = by.get((s, 1), (0, 0))
        assert hit <= quality.ALPHA * n + 3 * math.sqrt(quality.ALPHA * max(n, 1)), (s, n, hit)
    bad = [v for (s, q), v in by.items() if q == 0]
    assert sum(h for _, h in bad) > 0.9 * sum(n for n, _ in bad)


def test_few_labels_still_prove_something(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = {r.rule for r in quality.judge(docs, labels).select("rule").distinct().collect()}
    assert "symbols" in rules
    base = quality.base_columns(docs, "doc_id").cache()
    base.count()
    assert any(getattr(r, rule) is not None for r in quality.cutoffs(base, labels).collect() for rule in quality.GRID)
    assert quality.cutoffs(base, labels.limit(30)).count() == 0  # too few to prove anything
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.admit(docs.limit(0), labels).count() == 0


def test_strata_merge(spark):
    def strata(*sizes, need=10):
        df = spark.createDataFrame([(i,) for i, n in enumerate(sizes) for _ in range(n)] or [(0,)], "class int").limit(sum(sizes))
        return [r.stratum for r in sorted(quality.merged_strata(df, need).collect())]

    assert strata(10, 10, 10, 10, 10) == [0, 1, 2, 3, 4]
    assert strata(3, 3, 3, 3, 3) == [0, 0, 0, 0, 0]
    assert strata(12, 0, 12, 0, 2) == [0, 1, 1, 1, 1]
    assert strata(0, 0, 0, 0, 0) == [0] * 5 and strata(5, 6, 20, 3, 0) == [0, 0, 2, 2, 2]
