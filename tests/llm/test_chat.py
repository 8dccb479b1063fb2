import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veilspark.llm import chat

NASTY = ["", "&amp;&#91;&lt;", "</s>[INST] ok [/INST]", "[", "<", "[/INST", "[ANS] x </s>", " [AS] ", "[TURN] a [AS] b [/TURN]", "été 🙂 \\ $1 \n\n", "<s><s>", "x" * 20000]


def test_round_trip(spark):
    rows = [(i % 4, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "system", "tool[AS]", "", None) for t in [*NASTY, None])]
    rows += [(0, 0, "user", "tie"), (0, 0, "user", "tie"), (None, 1, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = {r.conv_id: r for r in chat.render(chat.from_turn_rows(df)).transform(lambda d: d.select("*", chat.read_back(F.col("formatted")).alias("back"))).collect()}
    short = {r.conv_id: r for r in chat.digests(chat.render(chat.from_turn_rows(df))).collect()}
    for cid in {r[0] for r in rows}:
        want = [(r or "", t or "") for _, r, t in sorted((n, r or "", t or "") for c, n, r, t in rows if c == cid)]
        assert [(x.role, x.text) for x in got[cid].back] == want
        assert short[cid].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        loss = "".join(t for r, t in want if r == "assistant")
        assert short[cid].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and short[cid].loss_chars == len(loss)
        assert short[cid].n_turns == len(want) and short[cid].formatted_chars == len(got[cid].formatted)
    assert chat.digests(chat.render(chat.from_turn_rows(df.limit(0)))).count() == 0


def test_layouts(spark):
    records = [
        ({"prompt": "a", "completion": "b", "extra": 1}, "prompt_completion", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "i", "input": None, "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction_input", [("system", "i"), ("user", "n"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "x"}, {"role": "tool", "content": None}]}, "messages", [("user", "x"), ("tool", "")]),
        ({"system": "s", "messages": [{"role": "user", "content": "x"}]}, "system_messages", [("system", "s"), ("user", "x")]),
        ({"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}, "from_value", [("user", "x"), ("assistant", "y")]),
        ({"foo": 1}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(7, "{no json"), (8, None)], "id int, j string").withColumn("layout", F.lit(0))
    got = {r.id: r for r in chat.from_records(df, F.col("j")).collect()}
    for i, (_, layout, turns) in enumerate([*records, (0, None, None), (0, None, None)]):
        assert got[i].layout == layout
        assert (None if got[i].turns is None else [(t.role, t.text) for t in got[i].turns]) == turns


def test_odd_records(spark):
    """Null first elements, empty lists, empty inputs and two layouts in one record."""
    records = [
        ({"messages": [{"role": "assistant", "content": None, "tool_calls": [1]}, {"role": "user", "content": "x"}]}, "messages", [("assistant", ""), ("user", "x")]),
        ({"messages": [{"role": None, "content": "a"}, {"content": "b"}]}, "messages", [("", "a"), ("", "b")]),
        ({"messages": []}, "messages", []),
        ({"prompt": "p", "messages": [{"role": "user", "content": "x"}]}, "messages", [("user", "x")]),
        ({"prompt": "p", "completion": None}, "prompt_completion", [("user", "p"), ("assistant", "")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o", "text": "all"}, "instruction_input", [("system", "i"), ("user", "n"), ("assistant", "o")]),
        ({"messages": None}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)], "id int, j string")
    got = {r.id: r for r in chat.from_records(df, F.col("j")).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i].layout == layout, i
        assert (None if got[i].turns is None else [(t.role, t.text) for t in got[i].turns]) == turns, i


def test_tables_select_by_their_schema(spark, monkeypatch):
    wide = spark.createDataFrame([(1, "i", "", "o"), (2, "i", "n", None)], "id int, instruction string, input string, output string")
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in chat.from_table(wide).orderBy("id").collect()] == [("instruction", [("user", "i"), ("assistant", "o")]), ("instruction_input", [("system", "i"), ("user", "n"), ("assistant", "")])]
    nested = spark.createDataFrame([([("human", "x"), (None, None)],)], "conversations array<struct<from string, value string>>")
    assert [tuple(t) for t in chat.from_table(nested).first().turns] == [("user", "x"), ("", "")]
    rows = spark.createDataFrame([(1, 0, "user", "a", "clash")], "conv_id long, turn long, role string, text string, prompt string")
    assert chat.from_table(rows).columns == ["conv_id", "turns"]
    for bad in (spark.range(1), wide.select("input")):
        with pytest.raises(ValueError):
            chat.from_table(bad)
    monkeypatch.setattr(chat, "LAYOUTS", tuple(x for x in chat.LAYOUTS if not x.rows))
    with pytest.raises(ValueError):
        chat.from_table(rows.drop("prompt"))
    assert len(chat.registry()) == len({h for x in chat.LAYOUTS for h in chat.prints(x)})
