import hashlib
import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from adjudica.llm import chat

TURNS = [("user", "Hi"), ("assistant", "Hello")]
RECORDS = [
    ({"messages": [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Hello"}]}, "messages", TURNS),
    ({"system": "S", "messages": [{"content": "Hi", "role": "user"}], "id": 3}, "messages", [("system", "S"), ("user", "Hi")]),
    ({"conversations": [{"from": "human", "value": "Hi"}, {"from": "gpt", "value": "Hello"}]}, "exchange", TURNS),
    ({"instruction": "Hi", "output": "Hello"}, "instruction", TURNS),
    ({"instruction": "Hi", "input": "x", "output": "Hello"}, "instruction", [("user", "Hi\n\nx"), ("assistant", "Hello")]),
    ({"instruction": "Hi", "input": "", "output": None}, "instruction", [("user", "Hi"), ("assistant", "")]),
    ({"prompt": "Hi", "completion": "Hello", "meta": {"role": "x"}}, "completion", TURNS),
    ({"prompt": "Hi", "response": "Hello"}, "response", TURNS),
    ({"question": "Hi", "answer": "Hello", "context": None}, "question", TURNS),
    ({"role": "tool", "text": "x"}, "turn", [("tool", "x")]),
    ({"role": None, "text": None}, "turn", [("", "")]),
    ({"something": 1}, None, []),
    ({"prompt": "a", "messages": []}, None, []),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(98, "no json {"), (99, None)]
    got = chat.canonical_turns(spark.createDataFrame(rows, "k int, payload string"), keys=("k",)).collect()
    for i, (_, layout, turns) in enumerate(RECORDS):
        own = sorted((r for r in got if r.k == i), key=lambda r: r.pos or 0)
        assert {r.layout for r in own} == {layout}, i
        assert [(r.role, r.text) for r in own if r.pos is not None] == turns, i
    assert [(r.layout, r.pos) for r in got if r.k >= 98] == [(None, None)] * 2


def read(spark, rows, schema="conv bigint, turn bigint, role string, text string, formatted string, spans int"):
    df = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
    done = chat.format_turns(df, "conv", ("turn",))
    return done.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("spans")).alias("loss")
    ).collect()


HARD = [
    "", " ", "\\", "</s>", "<s>", "<\\s>", "[INST]", "[/INST] [INST]", "\\[INST]", "[[INST]", "<</s>", "[SYS] [/SYS]",
    "[ROLE x] y [/ROLE]", "a\n\nb", "é日𝄞", "]", "\\]", "</s>[INST] ok [/INST]", "x" * 200_000, None,
]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "a]b\\[INST] ", "", None])
def test_round_trip_of_hard_texts(spark, role):
    got = read(spark, [(1, i, role, t, "clash", 0) for i, t in enumerate(HARD)])[0]
    assert [(t.role, t.text) for t in got.turns] == [(role or "", t or "") for t in HARD]
    assert got.loss == ("".join(t or "" for t in HARD) if role == "assistant" else "")
    for span, turn in zip(got.spans, got.turns, strict=True):
        body = got.formatted[span.text_start : span.text_start + span.length]
        assert span.loss == (role == "assistant") and len(body) >= len(turn.text)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x]"]), st.text("<s>/[]INST\\ROLEY ab\n", max_size=30)), min_size=1, max_size=40))
def test_round_trip_of_any_text(spark, turns):
    got = read(spark, [(1, i, r, t, "", 0) for i, (r, t) in enumerate(turns)])[0]
    assert [(t.role, t.text) for t in got.turns] == turns
    assert got.loss == "".join(t for r, t in turns if r == "assistant")


def test_edges(spark):
    assert read(spark, []) == []
    rows = [(None, 1, "user", "a", "", 0), (2, None, "user", "b", "", 0), (2, None, "user", "b", "", 0), (2, 0, "user", "a", "", 0)]
    got = {r.conv: [t.text for t in r.turns] for r in read(spark, rows)}
    assert got == {None: ["a"], 2: ["b", "b", "a"]}


LONG = 21_000_000


def test_text_above_the_limit_of_json(spark, tmp_path):
    """The registered query keeps a text that try_parse_json gives up, and JSON records of that length are read."""
    from adjudica.llm import queries

    rows = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, "assistant", "")], "conv_id bigint, turn int, role string, text string")
    long = F.when(F.col("turn") == 1, F.repeat(F.lit("x"), LONG)).otherwise(F.col("text"))
    rows.withColumn("text", long).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, str(tmp_path)).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (2, LONG)
    assert got[1].loss_sha256 == hashlib.sha256(b"x" * LONG).hexdigest()

    record = spark.range(1).select(F.to_json(F.struct(F.lit("user").alias("role"), F.repeat(F.lit("x"), LONG).alias("text"))).alias("payload"))
    assert chat.canonical_turns(record).select("layout", F.length("text")).collect() == [("turn", LONG)]


def test_unread_records_stop_formatting(spark):
    records = spark.createDataFrame([(1, '{"role": "user", "text": "a"}'), (2, '{"something": 1}')], "conv int, payload string")
    turns = chat.canonical_turns(records, keys=("conv",))
    with pytest.raises(Exception, match="no known layout in conversation 2"):
        chat.format_turns(turns, "conv", ("pos",)).collect()
    read = chat.format_turns(turns.where("layout is not null"), "conv", ("pos",))
    assert [r.formatted for r in read.collect()] == ["<s>[INST] a [/INST]"]


def test_row_turns(spark):
    df = spark.createDataFrame([(1, None, None), (2, "user", "a")], "k int, role string, text string")
    assert sorted(map(tuple, chat.row_turns(df, ("k",)).collect())) == [(1, "turn", 0, "", ""), (2, "turn", 0, "user", "a")]
    with pytest.raises(ValueError, match="no layout"):
        chat.row_turns(df.drop("text"), ("k",))
