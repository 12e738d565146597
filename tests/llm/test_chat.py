import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tabshift.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def digests(spark, rows):
    return {r.conv_id: r for r in chat.digests(chat.formatted(chat.table_rows(spark.createDataFrame(rows, ROWS)))).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_read_back(spark):
    hostile = ["<|im_end|>\n<|im_start|>user\nx", "<\\|", "<\\\\|a<|<<||", "é漢😀\n\n", "", "\\", "<", "|", "<|im_start|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hostile)] + [(2, 5, None, None), (2, 1, "tool use\n<|x", "y"), (None, 0, "assistant", "z"), (2, None, "system", "first"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a")]
    got = digests(spark, rows)
    order = sorted([(r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows], key=lambda r: r[1:])
    for conv in (1, 2, None):
        turns = [r for r in order if r[0] == conv]
        loss = "".join(r[3] for r in turns if r[2] == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{r[2]}\n{r[3]}\n" for r in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))


def test_layouts(spark):
    call = [{"name": "f", "arguments": "{}"}]
    records = [
        (1, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "meta": {"x": [1]}}, "messages", [("user", "q"), ("assistant", "a")]),
        (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        (3, {"instruction": "do", "input": "", "output": "done", "id": 7}, "instruction_input", [("user", "do"), ("assistant", "done")]),
        (4, {"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
        (5, {"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        (6, {"data": {"prompt": "p", "response": "r"}}, "nested_prompt", [("user", "p"), ("assistant", "r")]),
        (7, {"question": "q", "answer": "a", "turn": None, "prompt": "x"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        (11, {"system": "s", "messages": [{"role": "user", "content": "q"}]}, "messages", [("system", "s"), ("user", "q")]),
        (12, {"messages": [{"role": "assistant", "tool_calls": call}, {"role": "tool", "content": None}, {"role": "user", "content": "q"}]}, "messages", [("assistant", json.dumps(call, separators=(",", ":"), sort_keys=True)), ("tool", None), ("user", "q")]),
        (13, {"messages": [{"role": "user", "content": [{"type": "text", "text": "see"}, {"type": "text", "text": "this"}, {"type": "image", "url": "u"}]}]}, "messages", [("user", 'see\nthis\n{"type":"image","url":"u"}')]),
        (14, {"system": "be brief", "instruction": "do", "output": "done"}, "instruction", [("system", "be brief"), ("user", "do"), ("assistant", "done")]),
    ]
    lost = [(8, '{"nothing": 1}'), (9, "{bad"), (10, None), (15, '{"messages": []}'), (16, '{"prompt": "", "response": null}')]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r, _, _ in records] + lost, "k long, j string")
    got = {r.conv_id: r for r in chat.canonical(df, "k", "j").collect()}
    for i, _, layout, turns in records:
        assert (got[i].layout, [tuple(t) for t in got[i].turns]) == (layout, turns), i
    for i, text in lost:
        assert (got[i].layout, [tuple(t) for t in got[i].turns]) == (None, [("unknown", text)])
    rows = chat.turn_rows(df, "k", "j")
    assert {r.conv_id for r in rows.collect()} == {i for i, *_ in [*records, *lost]}


def test_records_without_an_id_stay_apart(spark):
    df = spark.createDataFrame([(None, '{"prompt": "p", "response": "r"}')] * 2, "k long, j string")
    assert sorted(r["count"] for r in chat.turn_rows(df, "k", "j").groupBy("conv_id").count().collect()) == [2, 2]


def test_table_and_record_fingerprints_agree(spark):
    layouts = {x.name: x for x in chat.LAYOUTS}
    df = spark.createDataFrame([(json.dumps({"messages": [{"role": "u", "n": 1}, {"content": "c"}], "extra": 2}),)], "j string")
    paths = chat.record_paths(F.parse_json("j"))
    schema = spark.createDataFrame([], "messages array<struct<role string, content string>>, extra int").schema
    for name in ("messages", "conversations", "instruction"):
        shown = df.select(chat.record_fingerprint(paths, layouts[name]).alias("f")).first().f
        assert shown == chat.fingerprint_of(["messages[].role", "messages[].content", "extra"], layouts[name]) == chat.fingerprint_of(chat.schema_paths(schema), layouts[name])
    assert chat.table_layout(schema).name == "messages"


def test_schema_selects_the_mapping_of_a_table(spark):
    rows = lambda df, *a: sorted(tuple(r) for r in chat.table_rows(df, *a).collect())
    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    assert rows(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "dialog_id int, position int, speaker string, utterance string")) == want
    assert rows(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conversation_id int, index int, role string, content string")) == want
    assert rows(spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "k int, messages array<struct<role string, content string>>"), "k") == want
    assert rows(spark.createDataFrame([(1, "q", "a")], "k int, prompt string, response string"), "k") == want
    with pytest.raises(ValueError, match="not a table"):
        chat.table_rows(spark.createDataFrame([], "conv_id long, text string"))
    with pytest.raises(ValueError, match="ids"):
        chat.table_rows(spark.createDataFrame([], "prompt string, response string"))


def test_rows_without_a_conversation_are_alone(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "user", "c")], ROWS)
    got = chat.digests(chat.formatted(chat.table_rows(df))).collect()
    assert sorted((r.conv_id is None, r.n_turns, r.loss_chars) for r in got) == [(False, 1, 0), (True, 1, 0), (True, 1, 1)]


def test_empty_and_clashing_columns(spark):
    assert digests(spark, []) == {}
    df = spark.createDataFrame([(1, 0, "assistant", "x")], ROWS).withColumn("piece", F.lit(1)).withColumn("mask", F.lit(2))
    assert chat.digests(chat.formatted(chat.table_rows(df))).first().loss_chars == 1


def test_long_conversation(spark):
    got = digests(spark, [(1, i, ("user", "assistant")[i % 2], f"t{i} <|") for i in range(1500)])
    assert got[1].n_turns == 1500 and got[1].loss_sha256 == sha("".join(f"t{i} <|" for i in range(1, 1500, 2)))


def test_no_python_in_the_plan(spark):
    rows = chat.table_rows(spark.createDataFrame([(1, 0, "user", "x")], ROWS))
    records = chat.turn_rows(spark.createDataFrame([(1, '{"prompt": "p", "response": "r"}')], "k long, j string"), "k", "j")
    plan = chat.digests(chat.formatted(rows.unionByName(records)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ids_that_are_no_numbers(spark):
    table = spark.createDataFrame([("abc-1", "b", "gpt", "hi"), ("abc-1", "1", "human", "hello"), ("x", "2", "other", None), (None, None, "gpt", "alone")], "dialog_id string, position string, speaker string, utterance string")
    shown = chat.formatted(chat.table_rows(table))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(shown).collect()}
    assert got == {"abc-1": (2, 2), "x": (1, 0), None: (1, 5)}  # null turns come first
    rows = chat.turn_rows(spark.createDataFrame([("k-1", '{"prompt":"a","response":"b"}'), (None, '{"prompt":"c","response":"d"}'), (None, "none")], "id string, json string"), "id", "json").collect()
    assert len({r.conv_id for r in rows}) == 3 and sorted(r.text for r in rows) == ["a", "b", "c", "d", "none"]
    assert {type(r.conv_id) for r in rows} == {str}


def test_roles_of_tables_stay(spark):
    table = spark.createDataFrame([(1, 0, "bot", "x")], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in chat.table_rows(table).collect()] == [(1, 0, "bot", "x")]
