import random
import zlib
from itertools import combinations, groupby

import numpy as np
from tokenizers import Tokenizer

from veilspark.llm import bpe, packing, token_files

LIB = Tokenizer.from_str(bpe.read_spec(bpe.default_tokenizer()))


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_files(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta,", "x\n", "é"], k=rnd.randint(0, 30)))) for i in rnd.sample(range(10**6), 300)] + [(5, None), (6, ""), (6, ""), (7, "z" * 30_000), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as start", "3 as file")
    token_files.write(docs, str(tmp_path / "t"), bpe.default_tokenizer())
    got = token_files.digests(token_files.read(spark, str(tmp_path / "t"))).collect()
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = np.array([*ids(t), 2], "<u4")
        want.append((d, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert token_files.write_and_digest(docs.limit(0), bpe.default_tokenizer()).count() == 0
    plan = token_files.read(spark, str(tmp_path / "t")).filter("doc_id = 5").select("n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,5)" in plan


def test_boundaries_are_optimal():
    rnd = random.Random(2)
    for _ in range(30):
        hist = {s: rnd.randint(1, 9) for s in rnd.sample(range(40), rnd.randint(1, 9))}
        for k in (1, 2, 3, 12):
            def cost(bounds):
                return sum(n * min(b for b in bounds if b >= s) for s, n in hist.items())
            top, rest = max(hist), [s for s in hist if s != max(hist)]
            want = min(cost([*c, top]) for m in range(min(k - 1, len(rest)) + 1) for c in combinations(rest, m))
            got = packing.boundaries(hist, k)
            assert cost(got) == want and len(got) <= k and got[-1] == top
    assert packing.boundaries({}) == []


def test_pack(spark):
    rnd = random.Random(3)
    rows = [(i, "word " * rnd.choice([0, 1, 3, 3, 3, 50, 90])) for i in range(300)] + [(500, "tok " * 700), (501, None), (7, "same"), (7, "same"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as bucket")
    got = packing.pack(docs, bpe.default_tokenizer(), context=64, buckets=4, budget=256).collect()
    want = sorted(str((d, p, len(ids(t)[p * 64 : p * 64 + 64]))) for d, t in rows for p in range(max(1, -(-len(ids(t)) // 64))))
    assert sorted(str((r.doc_id, r.piece, r.n_tokens)) for r in got) == want
    bounds = sorted({r.bucket for r in got})
    assert len(bounds) <= 4
    for b in bounds:
        own = [r for r in got if r.bucket == b]
        each = max(1, 256 // max(1, b))
        assert sorted((r.batch, r.slot) for r in own) == [divmod(i, each) for i in range(len(own))]
        assert all(r.padding == b - r.n_tokens >= 0 and b == min(x for x in bounds if x >= r.n_tokens) for r in own)
    assert packing.pack(docs.limit(0), bpe.default_tokenizer()).count() == 0


def test_packed_ids_are_the_encoding(spark):
    """Pieces joined in order give each document's encoding; padding and mask fill each row to its boundary."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta,", "x\n", "é", "日本"], k=rnd.randint(0, 60)))) for i in range(200)] + [(500, "tok " * 500), (501, None), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, bpe.default_tokenizer(), context=64, buckets=5, budget=256)
    by = {}
    for r in packing.unpacked(packed, bpe.default_tokenizer()).collect():
        by.setdefault(r.doc_id, []).append((r.piece, r.ids))
    for d, t in rows:
        assert [x for _, own in sorted(by[d]) for x in own] == ids(t)
    for r in packing.unpacked(packed, bpe.default_tokenizer(), 7).collect():
        assert len(r.ids) == len(r["mask"]) == r.bucket and r["mask"] == [1] * r.n_tokens + [0] * r.padding
        assert r.ids[: r.n_tokens] in [ids(t)[i : i + r.n_tokens] for d, t in rows if d == r.doc_id for i in [r.piece * 64]] and set(r.ids[r.n_tokens :]) <= {7}
    # a batch's rows are neighbours in the files, but for one cut between two files
    runs = [k for k, _ in groupby((r.bucket, r.batch) for r in packed.select("bucket", "batch").collect())]
    assert all(runs.count(k) <= 2 for k in runs)


def test_file_layout(spark, tmp_path):
    """Footers: dictionary or delta encodings, small row groups, page indexes."""
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(3000).selectExpr("id as doc_id", "repeat(concat('word', id % 7, ' text '), 20) as text")
    token_files.write(docs, str(tmp_path / "t"), bpe.default_tokenizer())
    n = 0
    for f in glob.glob(str(tmp_path / "t" / "*.parquet")):
        meta = pq.ParquetFile(f).metadata
        n += meta.num_rows
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 32 << 20
            columns = {group.column(c).path_in_schema.split(".")[0]: group.column(c) for c in range(group.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids"].encodings or "PLAIN_DICTIONARY" in columns["ids"].encodings
            assert any("DELTA" in e or "DICTIONARY" in e for e in columns["doc_id"].encodings)
            assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index and columns["ids"].has_offset_index
    assert n == 3000
