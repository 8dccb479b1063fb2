import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilspark.llm import bpe

SPEC = bpe.read_spec(bpe.default_tokenizer())
LIB = Tokenizer.from_str(SPEC)

CASES = [
    "", " ", "  ", "\n", "\n\n", "\n\n\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\n \nb", "x y", "x  y", "don't we'll I'M 's", " 's", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>",
    "été größer niño 日本語 ٣٤٥ 🙂🙂‍🔥", "a\x1cb \x1c c\x85d", "1234567 12a34", "!!!??? ...,,", "a,b.c, d .e ,f ..., 1,000.5 e.g., x_,y ., ,", "one,two. three,\nfour.\n", "1.5,2.25", ",", ".a", " ,", "\n,", "a,\nb.\n", "don't, 's.", "\t\ttabs\tand\r\nlines\r", "zzzzzzzzzzzzzzzzzzzz", "a" * 5000, "​ x　y", "�\x00\x01",
]


def check(texts):
    for make in (bpe.speculative_encoder, bpe.library_encoder):
        flat, counts = make(SPEC).encode(texts)
        for text, own in zip(texts, np.split(flat, np.cumsum(counts)[:-1])):
            assert own.tolist() == LIB.encode(text, add_special_tokens=False).ids, (make, text[:80])
            assert bpe.model_of(SPEC).decode(own) == LIB.decode(own.tolist(), skip_special_tokens=False)


def test_cases():
    check(CASES)


def test_random_texts():
    rnd = random.Random(5)
    alphabet = "aeiou stn\n\t'.,!<|>0123éßñ日🙂  ABC"
    check(["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(1500)])
    check(["".join(chr(rnd.choice([rnd.randrange(32, 0xD800), rnd.randrange(0xE000, 0x30000)])) for _ in range(20)) for _ in range(1500)])


def test_memo_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    bpe.speculative_encoder(SPEC).reset()
    check(CASES * 2)
    check([" ".join(f"w{i}" for i in range(2000)), " ".join(f"w{i}" for i in range(500, 2500))])  # far more than fit


def test_query(spark, tmp_path):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, "same"), (4, "same"), (None, "x<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = {(r.doc_id, r.n_tokens) for r in bpe.round_trip(docs, bpe.default_tokenizer()).collect()}
    assert got == {(i, len(LIB.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    ids = {(r.doc_id, tuple(r.ids)) for r in bpe.encode_texts(docs, bpe.default_tokenizer()).collect()}
    assert ids == {(i, tuple(LIB.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert bpe.round_trip(docs.limit(0), bpe.default_tokenizer()).count() == 0


def test_long_pieces_are_not_kept():
    """Texts without spaces and blobs: every one is new, and none may stay."""
    rnd = random.Random(9)
    for make in (bpe.speculative_encoder, bpe.library_encoder):
        encoder = make(SPEC)
        encoder.reset()
        for _ in range(4):
            texts = ["".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(1500)) for _ in range(5)] + ["".join(rnd.choices("abcXYZ0189+/", k=3000)) for _ in range(5)] + ["x" * 2500 + " y", "a b"]
            flat, counts = encoder.encode(texts)
            for text, own in zip(texts, np.split(flat, np.cumsum(counts)[:-1])):
                assert own.tolist() == LIB.encode(text, add_special_tokens=False).ids
            assert len(encoder.memo.keys) <= 4 and encoder.memo.used < 20


def test_white_space_of_all_kinds():
    rnd = random.Random(10)
    blanks = [" ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "  ", "\n\n", " \n", "\u200b"]
    check(["".join(rnd.choice([*blanks, "a", "Z9", "é", "日", "ñandú", ",", ".", "'s", "…", "–", "€", "1.5", "™"]) for _ in range(rnd.randint(1, 25))) for _ in range(3000)])


def test_hashes_tell_pieces_apart():
    memo = bpe.PieceMemo()
    data = np.frombuffer(b"".join(bytes([a, b, c]) for a in range(97, 123) for b in range(97, 123) for c in range(32, 64)), np.uint8)
    starts = np.arange(0, len(data), 3)
    keys = memo.hashes(data, starts, starts + 3)
    assert len(np.unique(keys)) == len(starts)
    again = memo.hashes(np.concatenate([np.frombuffer(b"xxxx", np.uint8), data]), starts + 4, starts + 7)
    assert (keys == again).all()  # a piece's hash doesn't depend on its place
    memo.add(keys, np.arange(len(keys), dtype=np.int32), np.ones(len(keys), np.int64))
    assert (memo.find(keys) == np.arange(len(keys))).all() and (memo.find(keys ^ np.uint64(2)) >= 0).mean() < 0.01
