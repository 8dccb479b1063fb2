"""Signatures by the standard's test vectors; conditions and reports on small rows."""

import pytest
from pyspark.sql import functions as F

from veilspark import signing
from veilspark.functions import native
from veilspark.operators import alerts, reports

# Test vectors 1 to 3 of RFC 8032 (seed, public key, message, signature).
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


@pytest.mark.parametrize(("seed", "key", "text", "signature"), VECTORS)
def test_signatures(seed, key, text, signature):
    seed, key, text, signature = map(bytes.fromhex, (seed, key, text, signature))
    assert signing.public_key(seed) == key and signing.sign(seed, text) == signature and signing.verify(key, text, signature)
    assert not signing.verify(key, text + b"x", signature) and not signing.verify(key, text, signature[:-1] + b"\xff")
    assert not signing.verify(key[:-1], text, signature) and not signing.verify(b"\xff" * 32, text, signature) and not signing.verify(key, text, signature[:32] + b"\xff" * 32)


def test_statements():
    text = signing.statement("head", "org/set", 3, 7, b"{}")
    assert text.split("\n")[:4] == ["head", "set: org/set", "publication: 3", "revision: 7"] and text.endswith("\n") and len(text.split("\n")) == 6
    key = bytes.fromhex(VECTORS[0][1])
    import base64

    assert signing.parse_key(" ed25519:" + base64.b64encode(key).decode()) == key and len(signing.key_id(key)) == 16
    for bad in ("x", "ed25519:AAAA", "ed25519:%"):
        with pytest.raises(ValueError):
            signing.parse_key(bad)


def test_held_for(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 200, True), ("a", 301, True), ("a", 302, False), ("a", 303, True), ("b", 1, None), ("b", 900, True)], "k string, s long, c boolean").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {(r.k, r.s): r.firing for r in alerts.held_for(rows, F.col("c"), ["k"], "ts", ["s"], 300).collect()}
    assert {k for k, v in got.items() if v} == {("a", 301)} and len(got) == 7
    assert alerts.held_for(rows.limit(0), F.col("c"), ["k"], "ts", ["s"], 300).count() == 0


def test_steps_and_rates(spark):
    rows = spark.createDataFrame([(0, 6), (65, 3), (250, 9)], "s long, rise long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    steps = alerts.every_step(alerts.by_step(rows, "ts", "rise", 60), 60)
    assert [(r.step, r.rise) for r in steps.orderBy("step").collect()] == [(0, 6), (60, 3), (120, 0), (180, 0), (240, 9)]
    assert [(r.step, r.rate) for r in alerts.rate(steps, 120, 60).orderBy("step").collect()] == [(0, 6 / 120), (60, 9 / 120), (120, 3 / 120), (180, 0), (240, 9 / 120)]
    assert alerts.every_step(alerts.by_step(rows.limit(0), "ts", "rise", 60), 60).count() == 0


def test_maps(spark):
    rows = spark.createDataFrame([("a", {"x": 1, "y": 2}), ("a", {"x": 5}), ("b", {}), ("c", None)], "g string, m map<string, bigint>")
    assert {r.g: r.m for r in reports.map_sums(rows, ["g"], "m").collect()} == {"a": {"x": 6, "y": 2}, "b": {}, "c": {}}
    assert reports.map_sums(rows.limit(0), ["g"], "m").count() == 0


def test_scores(spark):
    rows = spark.createDataFrame([(True, True)] * 3 + [(False, True), (True, None), (None, None)], "t boolean, v boolean").withColumn("k", F.lit("x"))
    got = reports.scores(rows, F.col("t"), F.col("v"), "k").filter("k = 'x'").first()
    assert (got.tp, got.fp, got.fn, got.tn, got.precision, got.recall) == (3, 1, 1, 1, 0.75, 0.75)


def test_written_numbers(spark):
    texts = ["4539 1488 0343 6467", "4539-1488-0343-6467.", "x4539148803436467", "1 4539 1488 0343 6467", "4539  1488 0343 6467", "4539148803436467", None, "+49 170 1234567", "415-555-0132, (415) 555-0132", "115-555-0132"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", native.written_cards(F.col("t")).alias("c"), native.written_phones(F.col("t")).alias("p")).orderBy("i").collect()
    assert [len(r.c or []) for r in got] == [1, 1, 0, 0, 0, 1, 0, 0, 0, 0]
    assert [r.p for r in got][7:] == [["+49 170 1234567"], ["415-555-0132", "(415) 555-0132"], []]
