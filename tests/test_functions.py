"""Scalar functions against plain Python."""

import math
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stavework.functions import music, rational, text


def test_rationals(spark):
    values = [(1, 2, 1, 3), (-7, 3, 7, 6), (0, 5, 1, 1), (6, -4, 3, 8), (10**12, 7, 1, 7)]
    df = spark.createDataFrame(values, "a bigint, b bigint, c bigint, d bigint")
    x, y = rational.make(F.col("a"), F.col("b")), rational.make(F.col("c"), F.col("d"))
    df = df.withColumn("x", x).withColumn("y", y)
    X, Y = F.col("x"), F.col("y")
    row = df.select(rational.text(rational.add(X, Y)), rational.text(rational.subtract(X, Y)), rational.text(rational.multiply(X, Y)), rational.text(rational.divide(X, Y)), rational.less(X, Y), rational.floor(X)).collect()
    for (a, b, c, d), r in zip(values, row):
        p, q = Fraction(a, b), Fraction(c, d)
        assert [Fraction(v) for v in r[:4]] == [p + q, p - q, p * q, p / q]
        assert (r[4], r[5]) == (p < q, math.floor(p))


def test_parse_rational(spark):
    df = spark.createDataFrame([("7/3",), ("4",), ("1.5",), ("-0.25",), ("x",), ("1/0",), (None,), ("",)], "s string")
    got = [r[0] for r in df.select(rational.text(rational.parse(F.col("s")))).collect()]
    assert got == ["7/3", "4", "3/2", "-1/4", None, None, None, None]
    assert spark.range(1).select(rational.lcm_of(F.array(F.lit(4), F.lit(6), F.lit(10)).cast("array<bigint>"))).first()[0] == 60
    near = spark.createDataFrame([(0.3333,), (None,)], "x double").select(rational.limit_denominator(F.col("x"), F.lit(1024)).alias("r")).collect()
    assert (near[0].r.num, near[0].r.den) == (1, 3)


def test_pitches(spark):
    df = spark.createDataFrame([("C", 0, 4), ("F", 1, 4), ("B", -1, 2), ("B", None, 3)], "s string, a int, o int")
    p = [F.col(c) for c in "sao"]
    assert [tuple(r) for r in df.select(music.midi(*p), music.diatonic(p[0], p[2]), music.label(*p)).collect()] == [(60, 28, "C4"), (66, 31, "F#4"), (46, 20, "Bb2"), (59, 27, "B3")]
    assert df.select(music.staff_step(F.lit("G"), F.lit(2), F.lit(0), p[0], p[2])).first()[0] == 6
    up = df.select(music.transpose(*p, F.lit(1), F.lit(2)).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in up] == [("D", 0, 4), ("G", 1, 4), ("C", 0, 3), ("C", 1, 4)]
    down = df.select(music.transpose(*p, F.lit(-2), F.lit(-3)).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in down][0] == ("A", 0, 3)


def test_intervals_keys_chords(spark):
    one = spark.range(1)
    i = lambda s: one.select(music.parse_interval(F.lit(s)).alias("i")).first().i
    assert tuple(i("M2")) == (1, 2) and tuple(i("-m3")) == (-2, -3) and tuple(i("P8")) == (7, 12) and tuple(i("M9")) == (8, 14) and tuple(i("A4")) == (3, 6)
    assert i("P2") is None and i("x") is None and i("M0") is None
    assert tuple(one.select(music.interval_from_semitones(F.lit(-14)).alias("i")).first().i) == (-8, -14)
    assert [one.select(music.key_alter(F.lit(f), F.lit(s))).first()[0] for f, s in ((2, "C"), (2, "G"), (-3, "A"), (-3, "D"), (0, "F"))] == [1, 0, -1, 0, 0]
    assert one.select(music.transpose_key(F.lit(0), F.lit(1), F.lit(2))).first()[0] == 2
    c = lambda s: one.select(music.parse_chord(F.lit(s)).alias("c")).first().c
    assert tuple(c("F#m7b5")) == ("F#", "half-diminished", None) and tuple(c("C/E")) == ("C", "major", "E") and tuple(c("B♭SUS4")) == ("Bb", "suspended-fourth", None)
    assert c("M7x") is None and c("hello") is None and tuple(c("AM7")) == ("A", "major-seventh", None)
    assert one.select(music.written_quarters(F.lit("half"), F.lit(2))).first()[0] == 3.5
    assert [one.select(music.octave_shift(F.lit(n), F.lit("down"))).first()[0] for n in (8, 15, 22)] == [1, 2, 3]


def test_names(spark):
    one = spark.range(1)
    lab = lambda s: one.select(text.part_label(F.lit(s)).alias("l")).first().l
    assert tuple(lab("Violin II")) == ("violin", 2) and tuple(lab("Flute 1")) == ("flute", 1) and tuple(lab("FIute")) == ("flute", None)
    assert lab("12") is None and lab("") is None
    fits = lambda a, b: one.select(text.names_compatible(F.lit(a), F.lit(b))).first()[0]
    assert fits("Vln. I", "Violin I") and fits("Fl.", "Flute 2") and not fits("Violin I", "Violin II") and not fits("Viola", "Violin") and not fits("Oboe", "")
    df = spark.createDataFrame([("Violin", None), ("??", "vc."), ("Bass", None), ("double bass", None), (None, None)], "n string, a string")
    assert [r[0] for r in df.select(text.instrument_range(F.col("n"), F.col("a"))["lo"]).collect()] == [55, 36, 40, 28, 21]
    names = spark.createDataFrame([("Celio",), ("Vocal bass",), ("double bass",), ("xyz",), ("Oboe",)], "n string")
    assert [r[0] for r in names.select(text.instrument_name(F.col("n"))).collect()] == [True, False, True, None, True]
    assert one.select(text.ocr_languages(F.lit("Deu, eng+deu"))).first()[0] == "deu+eng"
    assert one.select(text.slug(F.lit(" Ab c--D! "))).first()[0] == "ab-c-d"
    assert [one.select(text.stray(F.lit(s))).first()[0] for s in ("..", "k", "a", "la")] == [True, True, False, False]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=5), st.text("abc", max_size=5)), min_size=1, max_size=5))
def test_edit_distance(spark, pairs):
    def plain(x, y):
        return len(x or y) if not x or not y else min(plain(x[1:], y) + 1, plain(x, y[1:]) + 1, plain(x[1:], y[1:]) + (x[0] != y[0]))

    df = spark.createDataFrame([(list(a), list(b)) for a, b in pairs], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.edit_distance("a", "b")).collect()] == [plain(a, b) for a, b in pairs]
