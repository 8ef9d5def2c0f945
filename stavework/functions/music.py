"""Scalar functions on pitches, keys, clefs, intervals, note values and chord names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STEPS = "CDEFGAB"
SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SHARPS, FLATS = "FCGDAEB", "BEADGCF"
#: Diatonic number of the pitch a clef marks, and the line that it marks it on.
CLEFS = {"G": (32, 2), "F": (24, 4), "C": (28, 3)}
#: Usual name of each chromatic size within an octave, with its steps.
INTERVALS = {0: ("P1", 0), 1: ("m2", 1), 2: ("M2", 1), 3: ("m3", 2), 4: ("M3", 2), 5: ("P4", 3), 6: ("A4", 3), 7: ("P5", 4), 8: ("m6", 5), 9: ("M6", 5), 10: ("m7", 6), 11: ("M7", 6)}
#: Quarter notes of each written value.
VALUES = {"maxima": 32.0, "long": 16.0, "breve": 8.0, "whole": 4.0, "half": 2.0, "quarter": 1.0, "eighth": 0.5, "16th": 0.25, "32nd": 0.125, "64th": 0.0625, "128th": 0.03125}
#: Printed chord suffixes by kind.
CHORD_KINDS = {
    "major": ("", "M", "maj"),
    "minor": ("m", "mi", "min", "-"),
    "dominant": ("7",),
    "major-seventh": ("maj7", "M7", "ma7", "Δ7", "Δ"),
    "minor-seventh": ("m7", "mi7", "min7", "-7"),
    "diminished": ("dim", "°"),
    "diminished-seventh": ("dim7", "°7"),
    "half-diminished": ("m7b5", "m7-5", "-7b5", "ø", "ø7"),
    "augmented": ("aug", "+"),
    "augmented-seventh": ("aug7", "+7"),
    "major-minor": ("mmaj7", "mM7", "m(maj7)"),
    "major-sixth": ("6",),
    "minor-sixth": ("m6",),
    "dominant-ninth": ("9",),
    "major-ninth": ("maj9",),
    "minor-ninth": ("m9",),
    "dominant-11th": ("11",),
    "minor-11th": ("m11",),
    "dominant-13th": ("13",),
    "major-13th": ("maj13",),
    "minor-13th": ("m13",),
    "suspended-second": ("sus2",),
    "suspended-fourth": ("sus4", "sus"),
    "power": ("5",),
}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def semitone(step: Column) -> Column:
    return _map(SEMITONES)[step]


def midi(step: Column, alter: Column, octave: Column) -> Column:
    """12 (octave + 1) + semitone + alteration."""
    return (12 * (octave + 1) + semitone(step) + F.coalesce(alter, F.lit(0))).cast("int")


def diatonic(step: Column, octave: Column) -> Column:
    return (7 * octave + F.position(step, F.lit(STEPS)) - 1).cast("int")


def accidental(alter: Column) -> Column:
    a = F.coalesce(alter, F.lit(0))
    return F.when(a >= 0, F.repeat(F.lit("#"), a)).otherwise(F.repeat(F.lit("b"), -a))


def label(step: Column, alter: Column, octave: Column) -> Column:
    """``F#4``, ``Eb2``."""
    return F.concat(step, accidental(alter), octave.cast("string"))


def octave_shift(size: Column, kind: Column) -> Column:
    """Octaves of an 8, 15 or 22 line: its sign follows the type (``down`` is printed lower than it sounds)."""
    n = F.greatest(F.lit(1), F.call_function("div", size.cast("bigint") - 1, F.lit(7).cast("bigint"))).cast("int")
    return F.when(kind == "down", n).when(kind == "up", -n).otherwise(F.lit(0))


def middle_line(sign: Column, line: Column, octave_change: Column) -> Column:
    """Diatonic number of the staff's middle line under a clef; 34 under others."""
    x = F.lit(34)
    for s, (ref, own) in CLEFS.items():
        x = F.when(sign == s, ref + 2 * (3 - F.coalesce(line, F.lit(own))) + 7 * F.coalesce(octave_change, F.lit(0))).otherwise(x)
    return x.cast("int")


def staff_step(sign: Column, line: Column, octave_change: Column, step: Column, octave: Column) -> Column:
    """Steps below the middle line."""
    return middle_line(sign, line, octave_change) - diatonic(step, octave)


def key_alter(fifths: Column, step: Column) -> Column:
    """What a key does to a step: 1, -1 or 0."""
    f = F.coalesce(fifths, F.lit(0))
    sharp = F.position(step, F.substr(F.lit(SHARPS), F.lit(1), F.greatest(f, F.lit(0)))) > 0
    flat = F.position(step, F.substr(F.lit(FLATS), F.lit(1), F.greatest(-f, F.lit(0)))) > 0
    return F.when(sharp, 1).when(flat, -1).otherwise(0)


def transpose(step: Column, alter: Column, octave: Column, steps: Column, semitones: Column) -> Column:
    """The pitch ``steps`` and ``semitones`` away, as a struct; spelling follows the steps. Null past double accidentals."""
    old = 7 * octave + F.position(step, F.lit(STEPS)) - 1
    new = old + steps
    o = F.floor(new / F.lit(7)).cast("int")
    s = F.substr(F.lit(STEPS), (F.pmod(new, F.lit(7)) + 1).cast("int"), F.lit(1))
    a = midi(step, alter, octave) + semitones - 12 * (o + 1) - semitone(s)
    return F.when(F.abs(a) <= 2, F.struct(s.alias("step"), a.cast("int").alias("alter"), o.alias("octave")))


def concert(step: Column, alter: Column, octave: Column, semitones: Column) -> Column:
    """The sounding pitch of a part that transposes by ``semitones``; as written where that is null or 0."""
    n = F.coalesce(semitones, F.lit(0))
    i = interval_from_semitones(n)
    return F.when(n == 0, F.struct(step.alias("step"), F.coalesce(alter, F.lit(0)).cast("int").alias("alter"), octave.cast("int").alias("octave"))).otherwise(transpose(step, alter, octave, i["steps"], i["semitones"]))


def transpose_key(fifths: Column, steps: Column, semitones: Column) -> Column:
    """A key's fifths after a move; null beyond 7."""
    f = fifths + 7 * semitones - 12 * steps
    return F.when(F.abs(f) <= 7, f.cast("int"))


def interval_from_semitones(n: Column) -> Column:
    """struct(steps, semitones) in the usual spelling."""
    size, sign = F.abs(n), F.when(n < 0, -1).otherwise(1)
    steps = _map({k: v[1] for k, v in INTERVALS.items()})[F.pmod(size, F.lit(12))] + 7 * F.floor(size / F.lit(12))
    return F.struct((sign * steps).cast("int").alias("steps"), n.cast("int").alias("semitones"))


def parse_interval(text: Column) -> Column:
    """``M2``, ``-m3``, ``P5`` as struct(steps, semitones); null where number and quality don't fit."""
    t = F.trim(text)
    ok = t.rlike(r"^[+-]?[PMmAd][1-9]\d{0,3}$")
    sign = F.when(t.startswith("-"), -1).otherwise(1)
    quality = F.regexp_extract(t, r"([PMmAd])", 1)
    steps = F.regexp_extract(t, r"(\d+)$", 1).try_cast("int") - 1
    simple = F.pmod(steps, F.lit(7))
    natural = F.element_at(F.array(*[F.lit(SEMITONES[s]) for s in STEPS]), simple + 1) + 12 * F.floor(steps / F.lit(7))
    perfect = simple.isin(0, 3, 4)
    off = F.when(perfect, _map({"P": 0, "A": 1, "d": -1})[quality]).otherwise(_map({"M": 0, "m": -1, "A": 1, "d": -2})[quality])
    return F.when(ok & off.isNotNull(), F.struct((sign * steps).cast("int").alias("steps"), (sign * (natural + off)).cast("int").alias("semitones")))


def written_quarters(note_type: Column, dots: Column) -> Column:
    """Quarters of a written value: base (2 - 1 / 2^dots)."""
    return _map(VALUES)[note_type] * (2 - F.pow(F.lit(0.5), F.coalesce(dots, F.lit(0))))


def parse_chord(text: Column) -> Column:
    """``F#m7b5/A`` as struct(root, kind, bass); null where it is no chord name. Case matters for suffixes with m only."""
    t = F.trim(text)
    p = r"^([A-G])([#b♯♭]?)([^/]*?)(?:/([A-G])([#b♯♭]?))?$"
    exact = {s: k for k, ways in CHORD_KINDS.items() for s in ways}
    folded = {s.lower(): k for s, k in exact.items() if "m" not in s.lower()}
    suffix = F.replace(F.regexp_extract(t, p, 3), F.lit(" "), F.lit(""))
    kind = F.coalesce(_map(exact)[suffix], _map(folded)[F.lower(suffix)])
    mark = lambda g: F.translate(F.regexp_extract(t, p, g), "♯♭", "#b")
    bass = F.nullif(F.concat(F.regexp_extract(t, p, 4), mark(5)), F.lit(""))
    return F.when(t.rlike(p) & kind.isNotNull(), F.struct(F.concat(F.regexp_extract(t, p, 1), mark(2)).alias("root"), kind.alias("kind"), bass.alias("bass")))
