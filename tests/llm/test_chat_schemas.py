"""Chat formatting: fingerprints, mappings, the template's inverse, odd records."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sectorscope.llm import chat_schemas as C
from sectorscope.llm.queries import CONTROL_TEXT

_HARD = st.text(st.sampled_from(list("<|\\>im_startend%0A\n é\U0001f600")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(_HARD, _HARD), max_size=5))
def test_template_is_reversible(turns):
    formatted, spans = C.render(turns, frozenset(["assistant"]))
    assert C.parse(formatted) == turns
    assert [C.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_field_paths():
    record = {"a": 1, "b": [{"c": None, "d.e": [[{"f": 2}]]}, 3], "g": {}}
    assert C.field_paths(record) == {"a", "b", "b[].c", 'b[]."d.e"', 'b[]."d.e"[][].f', "g"}
    assert C.values_at(record, 'b[]."d.e"[][].f') == [2] and C.values_at(record, "b[].x") == []


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 7, "meta": {"x": [1]}},
     "messages", [("user", "q"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]},
                   {"role": "assistant", "content": "c"}]}, "message_parts", [("user", "ab"), ("assistant", "c")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r", "weight": 1}]},
     "share", [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ({"data": {"dialog": [{"speaker": "user", "utterance": "q"}]}}, "dialog", [("user", "q")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction_input", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "output": 5, "system": None}, "instruction", [("user", "i"), ("assistant", "5")]),
    ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "system": "s"}, "response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"question": "p", "answer": "c"}, "question", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "other": "c"}, None, None),
    ({"prompt": "p", "completion": "c", "response": "d"}, None, None),  # no mapping has both
    ({}, None, None), ([1], None, None), ({"messages": []}, None, None),
]


def test_layouts_and_odd_records(spark):
    rows = [(i, json.dumps(r), "clash") for i, (r, _, _) in enumerate(RECORDS)]
    rows += [(100, None, "x"), (101, "not json", "x"), (102, "[" * 100_000, "x"), (103, '{"prompt": "\\ud800", "completion": ""}', "x"),
             (None, rows[0][1], "x"), (0, rows[0][1], "clash")]
    df = spark.createDataFrame(rows, "conv_id long, record string, layout string")
    out = C.format_records(df, carry=("conv_id", "layout"))
    got = [(r.row.conv_id, r.layout, r.turns and [tuple(t) for t in r.turns], r.fingerprint) for r in out.collect()]
    by_id = {i: (name, turns) for i, name, turns, _ in got if i is not None}
    for i, (_, name, turns) in enumerate(RECORDS):
        assert by_id[i] == (name, turns), i
    assert all(by_id[i] == (None, None) for i in (100, 101, 102))
    assert by_id[103] == ("completion", [("user", "�"), ("assistant", "")])
    assert sum(i == 0 for i, *_ in got) == 2 and sum(i is None for i, *_ in got) == 1
    prints = {i: p for i, _, _, p in got}
    assert prints[100] is None and prints[9] is not None
    back = {r.row.conv_id: r for r in C.read_back(out.where("layout is not null")).collect()}
    assert all([tuple(t) for t in back[i].turns] == turns for i, (_, name, turns) in enumerate(RECORDS) if name)
    assert back[2].loss_texts == ["r"]
    assert C.read_back(out).where("formatted is null and turns is null").count() == sum(1 for _, n, _ in RECORDS if not n) + 3
    found = {(r.layout, r.n_records) for r in C.layouts_found(out).collect()}
    assert ("messages", 3) in found


def test_two_layouts_with_one_fingerprint():
    say = (C.Say("user", ("a",)),)
    with pytest.raises(ValueError):
        C.Registry((C.Layout("x", say), C.Layout("y", say)))


def test_rows_by_turn(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (2, 0, "user", "x" * 2_000_000),
            (None, 0, "user", "one"), (None, 0, "user", "one"), (3, 0, "assistant", CONTROL_TEXT)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = C.read_back(C.format_records(C.records_of_turns(df))).collect()
    got = sorted((r.row.conv_id or 0, [tuple(t) for t in r.turns], r.loss_texts) for r in out)
    assert got == [(0, [("user", "one")], []), (0, [("user", "one")], []),
                   (1, [("user", "a"), ("user", "a"), ("assistant", "b")], ["b"]),
                   (2, [("", ""), ("user", "x" * 2_000_000)], []), (3, [("assistant", CONTROL_TEXT)], [CONTROL_TEXT])]
    assert C.read_back(C.format_records(C.records_of_turns(df.limit(0)))).count() == 0
