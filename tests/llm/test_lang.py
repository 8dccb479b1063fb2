import math
import random
import zlib

import numpy as np

from veilspark.llm import lang_ppm

WORDS = {"aa": ["bako", "remi", "tolu", "sada"], "bb": ["straz", "chlum", "vrtky"], "cc": ["ñiño", "españ", "corazó"]}


def text(rnd, lang, n=12):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "x", "o"]) for _ in range(n))


def brute(samples, raw, order=3):
    """Code length in bits by dictionaries, from the definition."""
    counts = {}
    for t in samples:
        for i in range(len(t)):
            for d in range(min(i, order) + 1):
                own = counts.setdefault(t[i - d : i], {})
                own[t[i]] = own.get(t[i], 0) + 1
    bits = 0
    for i in range(len(raw)):
        d = next(d for d in range(min(i, order), -1, -1) if d == 0 or raw[i - d : i] in counts)
        while True:
            own = counts.get(raw[i - d : i], {})
            total, distinct = sum(own.values()), len(own)
            if raw[i] in own:
                bits += math.log2((total + distinct) / own[raw[i]])
                break
            if total:
                bits += math.log2((total + distinct) / distinct)
            if d == 0:
                bits += 8
                break
            d -= 1
    return bits


def test_code_lengths_match_the_definition():
    rnd = random.Random(1)
    samples = {k: [text(rnd, k).encode() for _ in range(20)] for k in WORDS}
    model = lang_ppm.fit(samples)
    raws = [text(rnd, k).encode() for k in WORDS] + ["zzz été 日本 ñ".encode(), b"a", b"b" * 300]
    got = lang_ppm.code_lengths(model, raws) / lang_ppm.UNIT
    want = [[brute(samples[k], r) for k in sorted(samples)] for r in raws]
    assert np.allclose(got, want, atol=0.02)


def test_predict(spark):
    rnd = random.Random(2)
    rows = [(i, text(rnd, lang), lang) for i in range(300) for lang in [rnd.choice(list(WORDS))]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "aa"), (903, "bako " * 50_000, None), (None, text(rnd, "bb"), "bb"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as __held")
    got = lang_ppm.predict(docs, "doc_id").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, lang in rows:
        assert by[i].held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1) and 0 <= by[i].score <= 1
        if lang and i not in (900, 901, 902):
            assert by[i].lang_pred == lang
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and by[903].lang_pred == "aa"
    kept = lang_ppm.admit(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert {r.lang_pred for r in lang_ppm.predict(docs.withColumn("lang", docs.lang.substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') lang"), "doc_id").collect()} == {"und"}
    assert lang_ppm.predict(docs.limit(0), "doc_id").count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_ppm.predict(docs, "doc_id", "lang").filter("held_out and lang_pred <> 'und'").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert got > 0.95
