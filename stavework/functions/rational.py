"""Exact rationals as ``struct<num:bigint,den:bigint>`` (normalised, sign on the numerator), and integer ticks.

Struct equality joins and groups normalised rationals. Struct order is not numeric order: compare with ``less`` or by
ticks. Ticks are exact where every denominator divides the ticks of a quarter note.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Ticks of a quarter note that hold every grid up to septuplets of 128ths, and their triplet and dotted repairs.
TICKS = 60480


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 92 are enough for any two bigints."""
    start = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.greatest(s["y"], F.lit(1))).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"]


def _div(a: Column, b: Column) -> Column:
    """Quotient of whole numbers, exact where b divides a (``/`` would go through double)."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def make(num: Column, den: Column) -> Column:
    """num / den, normalised; null for a zero denominator."""
    num, den = num.cast("bigint"), den.cast("bigint")
    g = F.greatest(gcd(num, den), F.lit(1)) * F.when(den < 0, F.lit(-1)).otherwise(F.lit(1))
    return F.when(den != 0, F.struct(_div(num, g).alias("num"), _div(den, g).alias("den")))


def add(a: Column, b: Column) -> Column:
    return make(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def subtract(a: Column, b: Column) -> Column:
    return make(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def multiply(a: Column, b: Column) -> Column:
    return make(a["num"] * b["num"], a["den"] * b["den"])


def divide(a: Column, b: Column) -> Column:
    return make(a["num"] * b["den"], a["den"] * b["num"])


def less(a: Column, b: Column) -> Column:
    return a["num"] * b["den"] < b["num"] * a["den"]


def floor(a: Column) -> Column:
    return _div(a["num"] - F.pmod(a["num"], a["den"]), a["den"])


def ticks(a: Column, per_quarter: int = TICKS) -> Column:
    """Whole ticks; null where the denominator doesn't divide them (then ``lcm_of`` gives a grid that does)."""
    return F.when(F.pmod(F.lit(per_quarter), a["den"]) == 0, a["num"] * _div(F.lit(per_quarter), a["den"]))


def text(a: Column) -> Column:
    """``7/3``, or ``4`` for whole numbers."""
    return F.when(a["den"] == 1, a["num"].cast("string")).otherwise(F.concat(a["num"].cast("string"), F.lit("/"), a["den"].cast("string")))


def parse(s: Column) -> Column:
    """``n``, ``n/d`` or a decimal such as ``1.5``; null for anything else."""
    t = F.trim(s)
    whole = F.when(t.rlike(r"^[+-]?\d{1,17}$"), make(t.cast("bigint"), F.lit(1)))
    ratio = F.when(t.rlike(r"^[+-]?\d{1,17}/\d{1,17}$"), make(F.split_part(t, F.lit("/"), F.lit(1)).try_cast("bigint"), F.split_part(t, F.lit("/"), F.lit(2)).try_cast("bigint")))
    digits = F.length(F.split_part(t, F.lit("."), F.lit(2)))
    decimal = F.when(t.rlike(r"^[+-]?\d{0,8}\.\d{1,9}$"), make(F.replace(t, F.lit("."), F.lit("")).try_cast("bigint"), F.rpad(F.lit("1"), digits + 1, F.lit("0")).try_cast("bigint")))
    return F.coalesce(whole, ratio, decimal)


@F.pandas_udf(StructType([StructField("num", LongType()), StructField("den", LongType())]))
def limit_denominator(x: pd.Series, most: pd.Series) -> pd.DataFrame:
    """The nearest rational to a double with a denominator of at most ``most``."""
    rows = [(None, None) if v is None or v != v else Fraction(v).limit_denominator(int(m)).as_integer_ratio() for v, m in zip(x, most)]
    return pd.DataFrame(rows, columns=["num", "den"], dtype="Int64")


def lcm_of(values: Column) -> Column:
    """Least common multiple of an array of positive numbers, 1 for an empty one."""
    return F.aggregate(values, F.lit(1).cast("bigint"), lambda acc, v: _div(acc, F.greatest(gcd(acc, v), F.lit(1))) * v)
