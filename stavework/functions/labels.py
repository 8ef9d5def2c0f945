"""Names of parts and files, written durations, rounding as reports print it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

# Fixed values.
OCTAVE_LOWER = r"contrabass|double\s*bass|^bass\b|^cb\.?$|^db\.?$|kontrabass"
TRANSPOSING = r"clar|\bcl\b|trump|\btpt|\btr\b|horn|\bhn\b|\bcor\b|sax|cornet|flug|\bin [a-g](?:b|#|s)?\b"
CONCERT = r"viol|vln|vla|cell|\bvc\b|bass|flute|\bfl\b|oboe|\bob\b|bassoon|\bbsn\b|piano|pno|organ|harp|guitar|recorder|trombone|\btbn\b|tuba"
SHORT_NAMES = {"violin": "Vln.", "viola": "Vla.", "violoncello": "Vc.", "cello": "Vc.", "double bass": "Cb.", "contrabass": "Cb.", "bass": "Cb.", "flute": "Fl.", "piano": "Pno."}
#: Engraver tokens of written values in quarter notes, longest first.
TOKENS = (("\\maxima", 32.0), ("\\longa", 16.0), ("\\breve", 8.0), ("1", 4.0), ("2", 2.0), ("4", 1.0), ("8", 0.5), ("16", 0.25), ("32", 0.125), ("64", 0.0625), ("128", 0.03125))


def sounding_shift(transpose: Column, name: Column, abbreviation: Column) -> Column:
    """Semitones from written to sounding pitch: the part's own, else an octave down for low instruments."""
    low = lambda c: F.coalesce(F.lower(F.trim(c)).rlike(OCTAVE_LOWER), F.lit(False))
    return F.when(F.coalesce(transpose, F.lit(0)) != 0, transpose).when(low(name) | low(abbreviation), -12).otherwise(0)


def may_transpose(transpose: Column, name: Column, abbreviation: Column, clefs: Column) -> Column:
    """Whether a staff of another key could be a transposing instrument's. ``clefs`` are its clef signs."""
    n = F.lower(F.concat_ws(" ", *[F.when((c != "Voice") & (c != ""), c) for c in (name, abbreviation)]))
    return F.when(F.coalesce(transpose, F.lit(0)) != 0, True).when(n.rlike(TRANSPOSING), True).when(n.rlike(CONCERT), False).otherwise(~F.coalesce(F.exists(clefs, lambda c: c.isin("C", "F")), F.lit(False)))


def short_name(name: Column) -> Column:
    """The usual short name with the rest of the name (``Violin 1`` gives ``Vln. 1``); null for other instruments."""
    p = r"(?i)^\s*(" + "|".join(sorted(SHORT_NAMES, key=len, reverse=True)) + r")\b\s*(.*)$"
    base = F.create_map(*[F.lit(x) for kv in SHORT_NAMES.items() for x in kv])[F.lower(F.regexp_extract(name, p, 1))]
    return F.when(name.rlike(p), F.rtrim(F.concat_ws(" ", base, F.regexp_extract(name, p, 2))))


def wrapped(name: Column, width: int = 10) -> Column:
    """The words packed into lines of at most ``width`` characters; a trailing role in parentheses is dropped."""
    words = F.split(F.trim(F.regexp_replace(name, r"\s*\([^()]*\)\s*$", "")), r"\s+")
    put = lambda acc, w: F.when(F.size(acc) == 0, F.array(w)).when(F.length(F.element_at(acc, -1)) + 1 + F.length(w) <= width, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), w)))).otherwise(F.concat(acc, F.array(w)))
    return F.aggregate(words, F.array().cast("array<string>"), put)


def confidence_class(c: Column) -> Column:
    """High from 0.8, medium from 0.5, low below, unknown for null and NaN."""
    return F.when(c.isNull() | F.isnan(c), "unknown").when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def spacing(duration: Column, shortest: Column) -> Column:
    """the room a note gets: 1 + log2 of its length over the shortest."""
    return 1 + F.log2(duration / shortest)


def file_name(s: Column) -> Column:
    """letters, digits, dots, hyphens and underscores; others become one underscore; no leading dot; never empty."""
    x = F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}._-]+", "_"), r"^[._]+", "")
    return F.when(x == "", "file").otherwise(x)


@F.pandas_udf(DoubleType())
def round_binary(x: pd.Series, digits: pd.Series) -> pd.Series:
    """F16: rounded as the exact binary value says, halves to even; for reports, where the last digit must agree."""
    return pd.Series([None if v is None or v != v else round(float(v), int(d)) for v, d in zip(x, digits)], dtype="float64")


@F.pandas_udf(ArrayType(StringType()))
def split_duration(num: pd.Series, den: pd.Series) -> pd.Series:
    """a length in quarters as written values, longest first, of at most two dots each; under a 128th is dropped."""
    from fractions import Fraction

    bases = [(t, Fraction(v)) for t, v in TOKENS]

    def one(n: int, d: int) -> list[str]:
        left, out = Fraction(n, d), []
        while left >= bases[-1][1]:
            token, base = next(b for b in bases if b[1] <= left)
            dots = max(k for k in range(3) if base * (2 - Fraction(1, 2**k)) <= left)
            out.append(token + "." * dots)
            left -= base * (2 - Fraction(1, 2**dots))
        return out

    return pd.Series([None if n is None or d is None or n != n or d != d or not d else one(int(n), int(d)) for n, d in zip(num, den)])
