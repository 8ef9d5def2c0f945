"""Scalar functions on names, labels and lyrics."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType

# Fixed values.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6}
#: Practical written ranges as MIDI numbers by part name; the first pattern that is found counts.
RANGES = (
    ("piccolo", 74, 108),
    ("flute|fl\\.", 59, 98),
    ("oboe|ob\\.", 58, 93),
    ("clarinet|cl\\.", 52, 96),
    ("bassoon|fag|bsn", 34, 76),
    ("horn|cor\\b|hn\\.", 42, 84),
    ("trumpet|tpt|trp", 54, 86),
    ("trombone|tbn", 40, 77),
    ("tuba", 26, 65),
    ("violin|vln|vn\\.", 55, 103),
    ("viola|vla", 48, 88),
    ("cello|vc\\.|vlc", 36, 81),
    ("contrabass|double bass|kontrabass|cb\\.|db\\.", 28, 67),
    ("guitar|gtr", 52, 88),
    ("soprano|^s\\.?$", 59, 84),
    ("alto|^a\\.?$", 53, 77),
    ("tenor|^t\\.?$", 47, 72),
    ("bass|^b\\.?$", 40, 65),
    ("piano|pno|keyboard|organ|harp", 21, 108),
)
DEFAULT_RANGE = ("default", 21, 108)
INSTRUMENTS = "piccolo|flute|\\bfl\\.|oboe|\\bob\\.|clarinet|\\bcl\\.|bassoon|fagott|\\bbsn|horn|\\bhn\\.|trumpet|\\btpt|\\btrp|trombone|\\btbn|tuba|violin|\\bvln|\\bvn\\.|viola|\\bvla|cello|\\bvc\\.|\\bvlc|contrabass|double bass|\\bcb\\.|\\bdb\\."
VOICES = "soprano|alto|tenor|baritone|voice|vocal|choir|chorus|(?<!double )\\bbass\\b"
INSTRUMENT_WORDS = ("piccolo", "flute", "oboe", "clarinet", "bassoon", "trumpet", "trombone", "violin", "viola", "cello", "violoncello", "contrabass", "fiddle")


def instrument_range(name: Column, abbreviation: Column) -> Column:
    """struct(rule, lo, hi): the first rule found in the name, else the first in the abbreviation, else the default."""
    x = F.struct(*[F.lit(v).alias(k) for k, v in zip(("rule", "lo", "hi"), DEFAULT_RANGE)])
    for text in (abbreviation, name):
        t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
        for rule in reversed(RANGES):
            x = F.when(t.rlike(rule[0]), F.struct(*[F.lit(v).alias(k) for k, v in zip(("rule", "lo", "hi"), rule)])).otherwise(x)
    return x


def part_label(name: Column) -> Column:
    """struct(letters, number) of a part name: trailing digits or a roman number i..vi are its number.

    A capital I within a word is a misread l; digits within words are misread letters. Null without letters.
    """
    words = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    roman = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    fix = lambda w: F.when(F.lower(w).isin(*ROMAN), F.lower(w)).otherwise(F.lower(F.concat(F.substring(w, 1, 1), F.translate(F.substring(w, 2, 1000), "I", "l"))))
    words = F.transform(words, fix)
    last = F.element_at(words, -1)
    number = F.when(F.size(words) > 1, F.coalesce(F.when(last.rlike(r"^\d{1,9}$"), last.try_cast("int")), roman[last]))
    kept = F.when(number.isNotNull(), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    letters = F.array_join(F.transform(kept, lambda w: F.when(w.rlike(r"\p{L}"), F.translate(w, "1058", "losb")).otherwise(w)), "")
    return F.when((F.size(words) > 0) & letters.rlike(r"^\p{L}+$"), F.struct(letters.alias("letters"), number.alias("number")))


def abbreviates(short: Column, long: Column) -> Column:
    """Whether ``short`` (letters only) has the first letter of ``long`` and the rest of its letters in order."""
    pattern = F.concat(F.lit("^"), F.array_join(F.split(short, "(?<=.)(?=.)"), ".*"))
    return (F.length(short) > 0) & F.call_function("rlike", long, pattern)


def names_compatible(a: Column, b: Column) -> Column:
    """Whether one part name abbreviates the other; a name without its number fits any number."""
    la, lb = part_label(a), part_label(b)
    numbers = la["number"].isNull() | lb["number"].isNull() | (la["number"] == lb["number"])
    shorter = F.when(F.length(lb["letters"]) < F.length(la["letters"]), abbreviates(lb["letters"], la["letters"])).otherwise(abbreviates(la["letters"], lb["letters"]))
    return F.coalesce(numbers & shorter, F.lit(False))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 matches / (both lengths) over the longest common blocks, taken recursively. Null if either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=True).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(BooleanType())
def like_an_instrument(name: pd.Series) -> pd.Series:
    """Whether a word of four letters or more is close to an instrument's name."""
    import re

    words = re.compile(r"[^\W\d_]{4,}")
    return pd.Series([any(difflib.get_close_matches(w, INSTRUMENT_WORDS, 1, 0.8) for w in words.findall((n or "").lower())) for n in name])


def instrument_name(name: Column) -> Column:
    """False for a voice's name, true for an instrument's or one close to it, null for neither."""
    t = F.lower(name)
    return F.when(t.rlike(VOICES), False).when(t.rlike(INSTRUMENTS), True).when(like_an_instrument(name), True)


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Unit-cost edit distance of two arrays of any tokens."""

    def one(x, y):  # noqa: ANN001, ANN202
        if x is None or y is None:
            return None
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            diagonal, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (p != q))
        return row[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")


def strip_dashes(s: Column) -> Column:
    return F.regexp_replace(s, r"[-\s]+$", "")


def slug(s: Column) -> Column:
    """Lower case letters and digits with single hyphens."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-"), F.lit("-"))


def stray(s: Column) -> Column:
    """A lyric that is no syllable: without a letter, or one letter that is no vowel."""
    t = F.trim(s)
    return ~t.rlike(r"\p{L}") | t.rlike(r"(?i)^[^\p{L}]*(?![aeiouyäöü])\p{L}[^\p{L}]*$")


def ocr_languages(s: Column) -> Column:
    """``Deu, eng+deu`` as ``deu+eng``: distinct, in order; null if any code isn't three letters."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.lower(s), "[,+]"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike("^[a-z]{3}(_[a-z]+)?$")), F.array_join(parts, "+"))


# Fixed value: marks that continue a word over several notes.
CONTINUATION = r"(?<!\p{L})(?:\s*[._\-\u2013\u2014\u00b7\u2026]){3,}\s*"


def clean_continuation(s: Column) -> Column:
    """words without their marks of continuation, single blanks; null where no letter or digit is left."""
    x = F.regexp_replace(F.trim(F.regexp_replace(s, F.lit(CONTINUATION), F.lit(" "))), F.lit(r"\s+"), F.lit(" "))
    return F.when(F.regexp_like(x, F.lit(r"[\p{L}\p{N}]")), x)


def close_matches(words: pd.Series, candidates: pd.Series, n: int = 3, cutoff: float = 0.6) -> pd.Series:
    """Of each row's candidates the n most similar to its word, at least ``cutoff``; of equals the later in order first."""
    out = []
    for word, of in zip(words, candidates):
        if word is None or of is None:
            out.append(None)
            continue
        m = difflib.SequenceMatcher()
        m.set_seq2(word)
        scored = []
        for x in of:
            if x is None:
                continue
            m.set_seq1(x)
            if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff and m.ratio() >= cutoff:
                scored.append((m.ratio(), x))
        out.append([x for _, x in sorted(scored, reverse=True)[:n]])
    return pd.Series(out, dtype=object)
