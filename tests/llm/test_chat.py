"""Chat formatting against a plain reading of the records."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skewlens.llm import chat

PIECES = st.sampled_from([*chat.CONTROL, "\\", "\\|", "|", "\n", "<", "|im_", "[", "INST]", "a", "é", "\U0001f600", "\\n"])


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def digests(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(said), sha(said), len("".join(chat.segment(r, t)[0] for r, t in turns))


def read(segments):
    rows = chat.read_back(chat.in_order(segments)).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(PIECES).map("".join), st.lists(PIECES).map("".join)), max_size=4))
def test_round_trip(turns):
    made = [chat.segment(r, t) for r, t in turns]
    assert chat.parse("".join(m[0] for m in made)) == turns
    for (whole, start, end), (_, text) in zip(made, turns):
        inside = whole[len(chat.START) : -len(chat.END)]
        assert not any(c in inside for c in chat.CONTROL)
        assert chat.unescape(whole[start:end]) == text


def test_given_conversations(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet")
    found = read(chat.segments(chat.turn_records(rows)))
    plain = {}
    for r in sorted(rows.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        plain.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert found == {k: digests(v) for k, v in plain.items()}


def test_odd_rows(spark):
    long_text = "word </s> " * 200_000
    rows = [
        (None, None, None, None),
        (None, 1, "user", "no id"),
        (1, 2, "assistant", long_text),
        (1, None, "user", "before"),
        (1, 2, "assistant", long_text),
        (1, 2, "a\nb</s>", ""),
        (2, 0, "", "\\"),
    ]
    df = rows_of(spark, rows).selectExpr("*", "'x' AS place", "'x' AS segment", "'x' AS record")
    found = read(chat.segments(chat.turn_records(df)))
    assert found == {
        None: digests([("", ""), ("user", "no id")]),
        1: digests([("user", "before"), ("a\nb</s>", ""), ("assistant", long_text), ("assistant", long_text)]),
        2: digests([("", "\\")]),
    }
    assert read(chat.segments(chat.turn_records(df.limit(0)))) == {}


LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 7},
    "messages in parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"text": "b"}]}]},
    "shared chat": {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "instruction": {"instruction": "do", "input": "this", "output": "done"},
    "instruction and response": {"instruction": "do", "context": "", "response": 5},
    "prompt and completion": {"prompt": "p", "completion": "c", "system": ""},
    "prompt and response": {"prompt": "p", "response": "r"},
    "question and answer": {"question": "q", "answer": "a"},
}
TURNS = {
    "messages": [("user", "q"), ("assistant", "")],
    "messages in parts": [("user", "ab")],
    "shared chat": [("system", "s"), ("user", "q"), ("assistant", "a")],
    "instruction": [("user", "do\nthis"), ("assistant", "done")],
    "instruction and response": [("user", "do"), ("assistant", "5")],
    "prompt and completion": [("user", "p"), ("assistant", "c")],
    "prompt and response": [("user", "p"), ("assistant", "r")],
    "question and answer": [("user", "q"), ("assistant", "a")],
}


def test_layouts(spark):
    odd = ["{", "[1]", "3", None, json.dumps({"else": {"a": [1]}}), json.dumps({"messages": []})]
    records = [(i, 0, json.dumps(v)) for i, v in enumerate(LAYOUTS.values())]
    records += [(100 + i, 0, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(records, "conv_id long, turn long, record string")
    assert read(chat.segments(df)) == {i: digests(t) for i, t in enumerate(TURNS.values())}
    seen = {r["layout"]: r["records"] for r in chat.layouts(df).where("layout IS NOT NULL").collect()}
    assert seen == dict.fromkeys(LAYOUTS, 1)
    rest = chat.layouts(df).where("layout IS NULL").collect()
    assert sum(r["records"] for r in rest) == len(odd) and sum(r["turns"] for r in rest) == 0
    assert sum(r["records"] for r in rest if r["fingerprint"] is None) == 4
    whole = {r["conv_id"]: r for r in chat.texts(chat.segments(df)).collect()}
    for i, turns in enumerate(TURNS.values()):
        assert chat.parse(whole[i]["formatted"]) == turns
        under = "".join(chat.unescape(whole[i]["formatted"][s["from"] : s["to"]]) for s in whole[i]["loss"])
        assert under == "".join(t for r, t in turns if r == "assistant")


@pytest.mark.parametrize("extra", [{}, {"meta": {"x": [1, {"y": 2}]}}])
def test_fingerprint_ignores_unknown_fields(extra):
    read_ = chat._reader(chat.MAPPINGS)
    plain, more = read_(json.dumps(LAYOUTS["instruction"])), read_(json.dumps({**extra, **LAYOUTS["instruction"]}))
    assert plain == more and plain[1] == "instruction"
