import corpus_pipeline
from test_near import brute
from veilspark.llm import simhash
from veilspark.llm.shared import materialize


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language", "near_duplicates", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns and docs.exceptAll(before).count() == 0
        if name == "near_duplicates":
            # one row of each group of texts with 0.8 or more of their five-word shingles in common
            assert sorted(str((r.doc_id, r.text)) for r in docs.collect()) == brute([(r.doc_id, r.text) for r in before.collect()])
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == docs.count() <= n


def test_near_duplicates_keep_one_row(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "x y z w"), (2, "x y z w"), (2, "x y z w"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as __nth_")
    got = simhash.admit(docs)
    assert got.columns == docs.columns and sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(map(str, [(None, "a b c d"), (2, "x y z w"), (9, None)]))


def test_stages_on_odd_tables(spark):
    """Empty tables, null columns, columns of clashing names and repeated rows pass each stage."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(40).unionByName(docs.limit(40)).unionByName(docs.limit(5).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as bigint) n_chars"))
    odd = odd.selectExpr("*", "1 as n_words", "'x' as rule", "2 as held_out", "3 as node", "4 as ids", "5 as class")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0, name
        out = stage(spark, odd, sf)
        if name == "packing":
            assert out.filter("piece = 0").count() == odd.count()
        else:
            assert empty.columns == docs.columns and out.columns == odd.columns and out.exceptAll(odd).count() == 0, name


def test_packed_texts_are_those_kept(spark):
    """Every kept document's ids, joined in order, are its encoding."""
    from tokenizers import Tokenizer

    from veilspark.llm import bpe, packing

    lib = Tokenizer.from_str(bpe.read_spec(bpe.default_tokenizer()))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in packing.unpacked(corpus_pipeline.pack(spark, docs, ""), bpe.default_tokenizer()).collect():
        by.setdefault(r.doc_id, []).append((r.piece, r.ids))
    assert {d: [x for _, own in sorted(v) for x in own] for d, v in by.items()} == {d: lib.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}
