"""Nested payloads against a plain recursive walk."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stavework.operators.nested import ARRAY_KEYS, LEVELS, OBJECTS, _walk, flatten_nested, is_json, level_table


def walk(payload):
    out = []

    def go(x, path, key, element):
        if x is None:
            return
        if isinstance(x, str):
            try:
                inner = json.loads(x)
            except ValueError:
                inner = None
            if isinstance(inner, (list, dict)):
                return go(inner, path, key, element)
        if key in ARRAY_KEYS and not element and not isinstance(x, list):
            path, element = [*path, "0"], True
        if element and key in LEVELS and not isinstance(x, list):
            out.append((LEVELS[key], ".".join(path)))
        elif key == "bbox" and isinstance(x, dict) and not element:
            out.append(("bbox", ".".join(path)))
        elif key == "pitch" and isinstance(x, dict) and not element and path[-3:-2] == ["notes"]:
            out.append(("pitch", ".".join(path)))
        if isinstance(x, dict):
            for k, v in x.items():
                go(v, [*path, k], k, False)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                go(v, [*path, str(i)], key if not element else "", True)

    if payload is not None and parses(payload):
        go(json.loads(payload), [], "", False)
    return sorted(out)


def nodes(texts):
    found, names = _walk(texts, ARRAY_KEYS, LEVELS, OBJECTS, False)
    return [(int(i), names[k], p) for a, b, c in zip(found.record, found.level, found.path) for i, k, p in zip(a, b, c.to_pylist())]


def got(payload):
    return sorted((k, p) for _, k, p in nodes([payload]))


def parses(text):
    def no(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=no)
    except ValueError:
        return False
    return True


KEYS = st.sampled_from(["staves", "measures", "events", "issues", "pitches", "bbox", "notes", "pitch", "parts", 'odd "\\ key', "x"])
LEAVES = st.one_of(st.none(), st.booleans(), st.integers(-99, 99), st.text(alphabet='ab"\\[]{},: é\n', max_size=6), st.sampled_from(['[{"events": 1}]', '{"bbox": {}}', "[", "A#5"]))
VALUES = st.recursive(LEAVES, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(KEYS, v, max_size=4)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=3), st.sampled_from([None, 1]))
def test_equals_plain_walk(values, indent):
    texts = [json.dumps(v, indent=indent) for v in values]
    texts.insert(1, '{"events": [1')  # broken ones between
    rows = nodes(texts)
    for i, t in enumerate(texts):
        assert sorted((k, p) for j, k, p in rows if j == i) == walk(t)


@settings(max_examples=400, deadline=None)
@given(VALUES, st.lists(st.tuples(st.integers(0, 60), st.sampled_from(['"', "\\", "{", "}", "[", "]", ",", ":", "1", "-", ".", "e", "u12", "n", "\n", "\t", " ", "", "null", "é"])), max_size=3))
def test_valid_where_the_parser_agrees(value, edits):
    text = json.dumps(value)
    for at, x in edits:
        text = text[:at] + x + text[at + 1 :]
    assert is_json(text) == parses(text), text


def test_rules():
    assert got('{"measures": [null, {"events": {"pitches": "A4"}}]}') == [("event", "measures.1.events.0"), ("measure", "measures.1"), ("pitch", "measures.1.events.0.pitches.0")]
    assert got('{"events": [1], "events": [1, 2]}') == [("event", "events.0"), ("event", "events.1")]  # the last of equal keys
    assert got(json.dumps({"staves": json.dumps([{"measures": json.dumps({"bbox": {}})}])})) == [("bbox", "staves.0.measures.0.bbox"), ("measure", "staves.0.measures.0"), ("staff", "staves.0")]
    for bad in (None, "", "  ", "{", "[1,]", '{"events": [NaN]}', '{"events": [1]} x', "nothing", '"text"', "5"):
        assert got(bad) == []


def test_flat_tables(spark):
    rows = [(1, '{"measures": [{"index": 3, "number": "4", "bbox": {"page": 0, "x": 1.5}, "events": [{"kind": "note", "pitches": ["A#4"], "confidence": "much"}]}]}', "a"), (2, None, "b"), (3, "{", "c")]
    df = spark.createDataFrame(rows, "record_id bigint, payload string, node_path string")  # a column with a clashing name
    nodes = flatten_nested(df, "record_id", "payload")
    assert nodes.filter("record_id <> 1").count() == 0
    m = level_table(nodes, "measure", "record_id").collect()
    assert [(r.node_path, r.m_index, r.m_number) for r in m] == [("measures.0", 3, "4")]
    e = level_table(nodes, "event", "record_id").first()
    assert (e.parent_level, e.parent_path, e.kind, e.confidence) == ("measure", "measures.0", "note", None)
    assert level_table(nodes, "pitch", "record_id").first().label == "A#4"
    b = level_table(nodes, "bbox", "record_id").first()
    assert (b.parent_path, b.page, b.x, b.h) == ("measures.0", 0, 1.5, None)
    assert flatten_nested(df.filter(F.lit(False)), "record_id", "payload").count() == 0


def test_long_and_deep():
    deep = '{"events":[' * 400 + "1" + "]}" * 400
    assert len(got(deep)) == 400
    for bad in ("[" * 200_000, '{"a":' * 3_000 + "x x" + "}" * 3_000, "[" * 3_000 + "]" * 2_999, "[" * 3_000 + "]" * 3_000 + " 1", '{"events": [1}]' * 1):
        assert got(bad) == [] and not is_json(bad)
    assert is_json("[" * 20_000 + "]" * 20_000)
    long = json.dumps({"issues": [{"kind": "x" * 1000}] * 2000})
    assert len(got(long)) == 2000
