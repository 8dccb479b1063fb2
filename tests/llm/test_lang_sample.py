import random

from test_lang import WORDS, text

from veilspark.llm import lang_ppm


def test_long_texts_and_copies_leave_a_full_sample(spark):
    rnd, bound = random.Random(3), 3000
    rows = [(text(rnd, "aa", 5000), "aa") for _ in range(3)]  # each far above the bound
    rows += [(text(rnd, "bb", 200)[:1500], "bb")] * 6000 + [(text(rnd, "bb", 12), "bb") for _ in range(60)]
    rows += [(text(rnd, "cc", 9000), "cc")] + [(text(rnd, "cc", 12), "cc") for _ in range(400)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    got = lang_ppm.sample(docs, bound)
    assert sorted(got) == sorted(WORDS)
    for name, texts in got.items():
        assert len(texts) == len(set(texts)) and bound - 200 < sum(map(len, texts)) <= bound, name
    assert len(got["aa"]) == 1 and len(got["bb"]) > 10 and len(got["cc"]) > 10


def test_order_by_hash(spark):
    rnd = random.Random(4)
    texts = [text(rnd, "aa") for _ in range(800)]
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    usable = docs.filter(~lang_ppm.held_out()).selectExpr("text", "xxhash64(text) h").distinct().collect()
    want, held = [], 0
    for r in sorted(usable, key=lambda r: r.h % 2**64):
        if held + len(r.text.encode()) > 5000:
            break
        want.append(r.text.encode())
        held += len(want[-1])
    assert lang_ppm.sample(docs, 5000)["aa"][: len(want)] == want
    assert sum(map(len, lang_ppm.sample(docs, 10**9)["aa"])) == sum(len(r.text.encode()) for r in usable)
