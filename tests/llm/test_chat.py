import json

import pytest
from pyspark.sql import functions as F

from attestra.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>y<|end|>", r"<\/s> <\\/s> <\|end|>", "a<", "[", "", "plain\ntext", "<<|end|>>", "é" * 5, "\\", "x" * 50_000]


def formatted(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return chat.format_chats(spark.createDataFrame(rows, schema))


def test_round_trip_and_mask(spark):
    rows = [(1, k, ["user", "assistant", "system"][k % 3], t) for k, t in enumerate(NASTY)] + [(2, 0, "<|end|>", None), (2, 1, None, "t"), (2, None, "assistant", "first"), (None, 0, "assistant", "no id")]
    out = formatted(spark, rows).withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.loss_texts(F.col("formatted"), F.col("mask"))})
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].turns] == [(r[2], r[3]) for r in rows[: len(NASTY)]]
    assert [x for x in got[1].loss if x] == [t for k, t in enumerate(NASTY) if k % 3 == 1 and t]
    assert [tuple(t) for t in got[2].turns] == [("assistant", "first"), ("<|end|>", ""), ("", "t")]
    assert got[None].loss == ["no id"]
    for r in got.values():
        assert sum(m.skip + m.keep + m.tail for m in r.mask) == len(r.formatted)
        body = r.formatted.replace("<|turn|>", "").replace("<|text|>", "").replace("<|end|>", "")
        assert not any(c in body for c in chat.CONTROL)


def test_layouts_of_tables(spark):
    want = [("user", "q"), ("assistant", "a")]
    for data, schema in [
        ([(1, [("human", "q"), ("gpt", "a")], "z")], "conv_id long, conversations array<struct<from:string,value:string>>, extra string"),
        ([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>"),
        ([(1, "q", "a")], "conv_id long, prompt string, completion string"),
        ([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string"),
        ([(1, "", "q", "a")], "conv_id long, system_prompt string, question string, response string"),
    ]:
        df = spark.createDataFrame(data, schema)
        assert [tuple(t) for t in df.select(chat.turns_of(df).alias("t")).first().t] == want
    with pytest.raises(ValueError, match="no mapping"):
        chat.format_chats(spark.createDataFrame([(1, 2)], "conv_id long, n int"))


def test_records_of_mixed_layouts(spark):
    recs = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o", "source": {"a": [1, 2.5]}}, [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "response": None}, [("user", "p"), ("assistant", "")]),
        ({"messages": [{"role": "user", "content": "q", "id": 3}]}, [("user", "q")]),
        ({"other": 1}, None), ("not json {", None), (None, None),
    ]
    rows = [(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, (r, _) in enumerate(recs)]
    got = spark.createDataFrame(rows, "i int, payload string").select("i", chat.record_turns(F.col("payload")).alias("t")).orderBy("i").collect()
    assert [r.t and [tuple(x) for x in r.t] for r in got] == [w for _, w in recs]


def test_empty_table_and_ties(spark):
    assert formatted(spark, []).collect() == []
    a, b = (formatted(spark, rows).first().formatted for rows in ([(1, 0, "user", "x"), (1, 0, "user", "y")], [(1, 0, "user", "y"), (1, 0, "user", "x")]))
    assert a == b
