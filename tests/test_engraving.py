"""Engraving rows, labels and the strict JSON form."""

import json

from pyspark.sql import functions as F

from stavework.functions import labels
from stavework.operators import engraving
from stavework.sources import score_json, text_files


def test_labels(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    s, none = F.lit, F.lit(None).cast("string")
    assert v(labels.short_name(s("Violin 1"))) == "Vln. 1" and v(labels.short_name(s("double bass"))) == "Cb." and v(labels.short_name(s("Zither"))) is None
    assert [v(labels.sounding_shift(s(t), s(n), none)) for t, n in ((-2, "x"), (0, "Double bass"), (0, "Bass drum"), (0, "Viola"))] == [-2, -12, -12, 0]
    no = F.array().cast("array<string>")
    assert v(labels.may_transpose(s(0), s("Clarinet"), none, no)) and not v(labels.may_transpose(s(0), s("Viola"), none, no)) and not v(labels.may_transpose(s(0), s("?"), none, F.array(s("F")))) and v(labels.may_transpose(s(0), s("?"), none, no))
    assert v(labels.wrapped(s("First Violin of two (solo)"))) == ["First", "Violin of", "two"]
    assert [v(labels.file_name(s(x))) for x in ("../a b?.xml", "...", "Äb-1.mxl")] == ["a_b_.xml", "file", "Äb-1.mxl"]
    assert [v(labels.confidence_class(s(x))) for x in (0.8, 0.5, 0.1, float("nan"))] == ["high", "medium", "low", "unknown"]
    assert v(labels.round_binary(s(2.675), s(2))) == 2.67 and v(labels.round_binary(s(0.5), s(0))) == 0.0
    assert v(labels.split_duration(s(7), s(2))) == ["2.."] and v(labels.split_duration(s(5), s(2))) == ["2", "8"] and v(labels.split_duration(s(1), s(100))) == []
    assert v(labels.spacing(s(4.0), s(1.0))) == 3.0


def test_excerpt_and_lines(spark):
    m = spark.createDataFrame([("s", i, str(i + 1), "G" if i == 0 else None, i if i == 1 else None, None) for i in range(5)], "k string, m_idx int, m_number string, clef string, key int, time string")
    got = [tuple(r) for r in engraving.excerpt(m, ["k"], 3, 2).orderBy("m_idx").collect()]
    assert got == [("s", 0, "3", "G", 1, None), ("s", 1, "4", None, None, None)]
    e = spark.createDataFrame([("s", 0, 1, 0, 1, "la", False), ("s", 0, 1, 1, 1, None, True), ("s", 0, 1, 2, 1, None, False), ("s", 0, 2, 0, 1, "no", False), ("s", 1, 1, 0, 1, "li", False), ("s", 1, 1, 1, 1, None, False)], "k string, m_idx int, voice_no int, ev_ord int, verse int, text string, continues boolean")
    assert [tuple(r) for r in engraving.lyric_line(e, ["k"]).collect()] == [("s", 1, "la _ li")]
    c = spark.createDataFrame([("s", 0, 2, 33, "C"), ("s", 0, 2, 40, "D"), ("s", 1, 1, 0, "X")], "k string, part_ord int, staff_no int, pos_ticks bigint, name string")
    ends = spark.createDataFrame([("s", 100)], "k string, end_ticks bigint")
    assert [tuple(r) for r in engraving.chord_spans(c, "k", ends, 1024).orderBy("at").collect()] == [("s", 32, 100, "D")]
    p = spark.createDataFrame([("s", 0, "Violin"), ("s", 1, "violin "), ("s", 2, None)], "k string, part_ord int, name string")
    assert [r.slug for r in engraving.part_slugs(p, "k").orderBy("part_ord").collect()] == ["violin-a", "violin-b", "part"]
    lay = spark.createDataFrame([("f", 1, '\\new Lyrics \\lyricsto "va" { \\x }'), ("f", 2, "other")], "path string, line int, text string")
    assert [r.line for r in engraving.without_lyrics(lay, spark.createDataFrame([("va",)], "voice string")).collect()] == [2]


def test_tuplets_and_words(spark):
    marks = spark.createDataFrame([("s", 1, 2.0, 0.0)], "k string, mark bigint, x double, y double")
    ev = spark.createDataFrame([("s", 1, i, float(x), 1.0, 90, True) for i, x in enumerate([1, 2, 3, 8])], "k string, voice_no int, ev_ord int, x double, y double, duration_ticks bigint, plain boolean")
    assert [tuple(r) for r in engraving.printed_tuplets(marks, ev, ["k"]).collect()] == [("s", 1, 1, 0, 3)]
    assert engraving.split_word("lala", 0, 40, [(10, 0, False), (30, 20, False)]) == ["la", "la"]
    assert engraving.split_word("krst", 0, 40, [(10, 0, False), (30, 20, False)]) is None
    w = spark.createDataFrame([("lala", 0.0, 40.0, [(10.0, 0.0, False), (30.0, 20.0, False)]), (None, 0.0, 1.0, None)], "text string, x double, w double, anchors array<struct<centre:double,left:double,melisma:boolean>>")
    assert [r.pieces for r in engraving.split_words(w).collect()] == [["la", "la"], None]
    xs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "room double, x double")
    slope, misfit = xs.select(*engraving.spacing_fit(F.col("x"), F.col("room"))).first()
    assert round(slope, 3) == 2.25 and 0 < misfit < 0.2


def test_score_json(spark):
    ok = {"title": "t", "parts": [{"id": "P1", "staves": [{"number": 1, "measures": [{"index": 0, "voices": [{"number": 1, "events": [{"kind": "note", "offset": "1/2", "duration": "1", "notes": [{"pitch": {"step": "C", "alter": 0, "octave": 4}}]}]}]}]}]}]}
    bad = [json.dumps({**ok, "more": 1}), "x", None, json.dumps({"title": "t"}), json.dumps(ok).replace('"C"', '"H"'), json.dumps(ok).replace('"note"', '"sound"')]
    d = score_json.read_json(spark.createDataFrame([(i, t) for i, t in enumerate([json.dumps(ok), *bad])], "id int, text string"), "text")
    assert [r.error for r in d.orderBy("id").collect()] == [None, "unknown field", "no JSON object", "no JSON object", "parts missing", "pitch", "kind"]
    e = score_json.json_events(d, "id").collect()
    assert [(r.id, r.part_ord, r.kind, r.offset) for r in e] == [(0, 0, "note", "1/2")]


def test_text_files(spark):
    src = "va = {\n  % m. 1\n\n  c4 d\n  % m. 2\n  e1\n}\nvb = {\n  % m. 1\n  f1\n}\n"
    f = spark.createDataFrame([("p.ly", src)], "path string, text string")
    got = [tuple(r) for r in text_files.source_lines(f, spark.createDataFrame([("va",)], "variable string")).orderBy("line").collect()]
    assert got == [("p.ly", 4, "va", "1"), ("p.ly", 6, "va", "2")]
    log = spark.createDataFrame([("a.ly:3:7: warning: bar check failed at: 3/4",), ("noise",)], "s string")
    assert [tuple(r) for r in text_files.diagnostics(log, "s").collect()] == [("warning", "bar check failed at: 3/4", "a.ly", 3, 7)]
