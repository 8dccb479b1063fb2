"""Line assembly against a plain loop over writes, and line differences against brute force."""

import itertools
import random

from veilspark.operators.policies import line_diff
from veilspark.streaming import assemble


def plain(writes, most):
    """(tgid, fd) -> lines with their overflow marks, write by write."""
    held, out = {}, {}
    for tgid, fd, _, data in sorted(writes, key=lambda w: w[2]):
        done, held[tgid, fd] = assemble.cut(held.get((tgid, fd), b""), data, most)
        out.setdefault((tgid, fd), []).extend(done)
    for key, rest in held.items():
        if rest:
            out[key].append((rest, False))
    return {k: [(x.decode("utf-8", "replace"), over) for x, over in v] for k, v in out.items() if v}


def test_table_agrees_with_the_loop(spark):
    rnd = random.Random(1)
    writes = [(rnd.randrange(3), rnd.randrange(1, 3), n, "".join(rnd.choice(["a", "é", "日本", "\n", "\n\n", "xyz"]) for _ in range(rnd.randint(0, 9))).encode()) for n in range(400)]
    split = [(9, 1, 1000, b"caf\xc3"), (9, 1, 1001, b"\xa9\n"), (9, 1, 1002, b"\xff bad"), (9, 2, 1003, b"x" * 30), (9, 2, 1004, b"\n"), (9, 2, 1005, b"x" * 19), (9, 2, 1006, b"y" * 20 + b"\n" + b"z" * 20)]
    for most, span in ((20, 7), (20, 10_000), (1 << 20, 50)):
        got = {}
        df = spark.createDataFrame(writes + split, "tgid int, fd int, seq long, data binary").repartition(3)
        for r in sorted(assemble.assemble(df, most, span).collect(), key=lambda r: (r.line_no, r.part)):
            got.setdefault((r.tgid, r.fd), []).append((r.line, r.overflow))
        assert got == plain(writes + split, most), (most, span)
    assert got[9, 1][0] == ("café", False)
    assert assemble.assemble(df.limit(0)).count() == 0


def test_records(spark):
    def record(tgid, fd, size, flags, data):
        return b"".join(x.to_bytes(4, "little") for x in (tgid, fd, size, flags)) + data

    rows = [(1, record(2**32 - 1, 1, 3, 0, b"abc")), (2, record(7, 2, 2, 1, b"\xffx extra")), (3, record(7, 2, 9, 2, b"short")), (4, b"tiny"), (5, record(0, 0, 0, 3, b"")), (6, None)]
    got = {r.id: (r.tgid, r.fd, r.flags, None if r.data is None else bytes(r.data)) for r in assemble.decode_records(spark.createDataFrame(rows, "id int, record binary")).collect()}
    assert got == {1: (2**32 - 1, 1, 0, b"abc"), 2: (7, 2, 1, b"\xffx"), 3: (None,) * 4, 4: (None,) * 4, 5: (0, 0, 3, b""), 6: (None,) * 4}


def test_outcomes(spark):
    writes = spark.createDataFrame([(1, 1, 1, b"x" * 30, 0), (1, 1, 2, b"a\n", 1), (1, 1, 3, b"b\n", None), (1, 1, 4, b"c\n", 2)], "tgid int, fd int, seq long, data binary, flags int")
    got = assemble.outcomes(writes, assemble.assemble(writes, 20)).collect()
    assert {r.outcome: r.n for r in got} == {"ok": 2, "truncated": 2, "overflow": 1}


def test_line_diff():
    rnd = random.Random(2)
    for _ in range(600):
        a, b = (rnd.choices("abc", k=rnd.randint(0, 6)) for _ in range(2))
        got = line_diff(a, b)
        assert [x for op, x in got if op != "+"] == a and [x for op, x in got if op != "-"] == b
        best = max(len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if (it := iter(b)) and all(x in it for x in c))
        assert sum(op == " " for op, _ in got) == best
    assert line_diff(["a", "b"], ["c", "d"]) == [("+", "c"), ("+", "d"), ("-", "a"), ("-", "b")]
