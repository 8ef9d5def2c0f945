"""The MusicXML reader and the checks on what it reads."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stavework.operators import checks
from stavework.sources import musicxml

HEAD = '<score-partwise version="4.0"><work><work-title>T</work-title></work><part-list><score-part id="P1"><part-name>Horn in F</part-name></score-part></part-list><part id="P1">'
SCORE = (
    HEAD
    + """
<measure number="0" implicit="yes"><attributes><divisions>6</divisions><key><fifths>9</fifths></key><time><beats>2+2</beats><beat-type>4</beat-type></time>
 <clef><sign>G</sign><line>2</line></clef><transpose><chromatic>-7</chromatic></transpose></attributes>
 <note><pitch><step>D</step><octave>5</octave></pitch><duration>6</duration><voice>1</voice><type>quarter</type></note></measure>
<measure number="1">
 <note><grace/><pitch><step>E</step><octave>5</octave></pitch><voice>1</voice><type>16th</type></note>
 <note><pitch><step>G</step><octave>4</octave></pitch><duration>12</duration><tie type="start"/><voice>1</voice><lyric><text>la</text></lyric></note>
 <note><chord/><pitch><step>B</step><alter>-1</alter><octave>4</octave></pitch><duration>12</duration><voice>1</voice></note>
 <harmony><root><root-step>G</root-step><root-alter>1</root-alter></root><kind text="7">dominant</kind></harmony>
 <note><pitch><step>A</step><octave>4</octave></pitch><duration>4</duration><voice>1</voice><time-modification><actual-notes>3</actual-notes><normal-notes>2</normal-notes></time-modification></note>
 <forward><duration>8</duration></forward><backup><duration>24</duration></backup>
 <note><rest measure="yes"/><duration>24</duration><voice>2</voice></note></measure>
<measure number="2"><attributes><measure-style><multiple-rest>3</multiple-rest></measure-style></attributes>
 <note><rest/><duration>24</duration><voice>1</voice></note><barline location="right"><bar-style>light-heavy</bar-style><repeat direction="backward"/></barline></measure>
<measure number="5"><note><pitch><step>C</step><octave>2</octave></pitch><duration>18</duration><voice>1</voice></note></measure>
</part></score-partwise>"""
)


@pytest.fixture(scope="module")
def scores(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("scores")
    (d / "one.musicxml").write_text(SCORE)
    with zipfile.ZipFile(d / "two.mxl", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="in/s.xml"/></rootfiles></container>')
        z.writestr("other.xml", "<x/>")
        z.writestr("in/s.xml", SCORE)
    (d / "bad.xml").write_text("<score-timewise/>")
    (d / "empty.xml").write_bytes(b"")
    return musicxml.read_scores(spark, str(d)).cache()


def test_reader(scores):
    assert {r.score_id: r.error is None for r in scores.select("score_id", "error").collect()} == {"one": True, "two": True, "bad": False}  # files without a byte give no row
    e = musicxml.table(scores, "event").filter("score_id = 'one'").orderBy("m_idx", "voice_no", "ev_ord").collect()
    m1 = [(x.voice_no, x.kind, x.onset.num, x.onset.den, x.duration.num, x.duration.den, x.grace) for x in e if x.m_idx == 1]
    assert m1 == [(1, "note", 0, 1, 0, 1, True), (1, "chord", 0, 1, 2, 1, False), (1, "note", 2, 1, 2, 3, False), (2, "rest", 0, 1, 4, 1, False)]
    assert [x.m_idx for x in e if x.kind == "rest"] == [1, 2, 3, 4]  # the rest of three measures is expanded
    chord = next(x for x in e if x.kind == "chord")
    assert [(n.pitch.step, n.pitch.alter, n.tie_start) for n in chord.notes] == [("G", 0, True), ("B", -1, False)] and chord.lyrics[0].text == "la"
    m = musicxml.table(scores, "measure").filter("score_id = 'two'").orderBy("m_idx").collect()
    assert [x.m_idx for x in m] == [0, 1, 2, 3, 4, 5] and [x.added for x in m] == [False, False, False, True, True, False]
    assert (m[0].key.fifths, m[0].time.beats, m[0].implicit, m[2].right_barline.repeat) == (7, 4, True, "backward")
    assert musicxml.table(scores, "part").first().transpose_semitones == -7
    assert [(c.root, c.kind, c.onset.num) for c in musicxml.table(scores, "chord").filter("score_id = 'one'").collect()] == [("G#", "dominant", 2)]
    w = musicxml.written_index(musicxml.table(scores, "measure").filter("score_id = 'one'"), ["score_id", "part_ord", "staff_no"]).orderBy("m_idx").collect()
    assert [x.written for x in w] == [0, 1, 2, 2, 2, 3]


def test_rhythm_check(scores):
    v = checks.voice_lengths(musicxml.table(scores, "event"))
    bad = checks.rhythm_check(musicxml.table(scores, "measure"), v).filter("score_id = 'one'").orderBy("m_idx").collect()
    # the pickup of one quarter is excused, and so is the last measure of three
    assert [(r.m_idx, r.measure, r.voice_no) for r in bad] == [(1, "1", 1)]
    ticks = scores.filter("score_id = 'one'").first().ticks_per_quarter
    assert (bad[0].expected, bad[0].actual * 3) == (4 * ticks, 8 * ticks)


def test_lyrics_and_alignment(spark, scores):
    parts = musicxml.table(scores, "part")
    e = musicxml.table(scores, "event").filter(F.size("lyrics") > 0).withColumn("measure", F.col("m_idx").cast("string"))
    assert [(r.score_id, r.n_events, r.measures, r.staves) for r in checks.lyrics_check(parts, e).orderBy("score_id").collect()] == [("one", 1, ["1"], [1]), ("two", 1, ["1"], [1])]
    bar = "struct<style:string,repeat:string>"
    rows = [("a", 0, 1, 0, None), ("a", 0, 1, 1, ("x", None)), ("a", 1, 1, 0, None), ("a", 1, 1, 1, ("y", None)), ("a", 1, 2, 0, ("x", None)), ("b", 0, 1, 0, None)]
    m = spark.createDataFrame(rows, f"score_id string, part_ord int, staff_no int, m_idx int, right_barline {bar}")
    got = sorted(tuple(r) for r in checks.alignment_check(m).fillna(-1).collect())
    assert got == [("a", "barline", 1, 1, 1), ("a", "barline", 1, 2, 0), ("a", "measure-count", -1, -1, -1)]


def test_plain_bytes():
    assert musicxml.container(b"<x/>") == b"<x/>"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("META-INF/x", "no")
        f.writestr("a.xml", "<x/>")
    assert musicxml.container(z.getvalue()) == b"<x/>"
    with pytest.raises(ValueError):
        musicxml.parse(b"no xml")


def test_write_read_write(spark, scores, tmp_path):
    from stavework.sources.musicxml_writer import write_scores

    first = {r.score_id: r.musicxml for r in write_scores(scores).collect()}
    assert set(first) == {"one", "two"}
    (tmp_path / "one.musicxml").write_text(first["one"])
    again = musicxml.read_scores(spark, str(tmp_path)).cache()
    assert {r.score_id: r.musicxml for r in write_scores(again).collect()} == {"one": first["one"]}
    cols = ["part_ord", "staff_no", "m_idx", "voice_no", "kind", "onset", "duration", "grace", "notes"]
    a = musicxml.table(scores.filter("score_id = 'one'"), "event").select(*cols).orderBy("m_idx", "voice_no", "ev_ord").collect()
    assert a == musicxml.table(again, "event").select(*cols).orderBy("m_idx", "voice_no", "ev_ord").collect()


def test_marks():
    from stavework.sources.musicxml_writer import beam_marks, tuplet_marks

    ev = lambda t, d, kind="note", note="eighth", tup=None: {"offset_ticks": t, "duration_ticks": d, "kind": kind, "note_type": note, "grace": False, "tuplet": tup}
    t = {"actual": 3, "normal": 2}
    assert tuplet_marks([ev(0, 4, tup=t), ev(4, 4, tup=t), ev(8, 4, tup=t), ev(12, 6)]) == {0: "start", 2: "stop"}
    b = beam_marks([ev(0, 6), ev(6, 3, note="16th"), ev(9, 3, note="16th"), ev(12, 6), ev(18, 6, "rest"), ev(24, 6)], 12, (4, 4))
    assert b == {0: [(1, "begin")], 1: [(1, "continue"), (2, "begin")], 2: [(1, "end"), (2, "end")]}
