"""Measures and staves on the page: which stack of the page a measure is, and which of its staves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.operators.windows import running_sum


def number_stacks(stacks: DataFrame, score: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """The stacks of a score counted from 0 in the order of page, system and place."""
    d = running_sum(stacks.withColumn("__one", F.lit(1).cast("bigint")), [score], order, "__one", name)
    return d.withColumn(name, F.col(name) - 1).drop("__one")


def place_measures(measures: DataFrame, stacks: DataFrame, score: str, written: str, ordinal: str = "ordinal", first: int = 0) -> DataFrame:
    """The measures with their stack as a struct: that whose number is the measure's written one, moved by the movement's ``first``.

    Null past the last stack.
    """
    s = stacks.select(F.col(score).alias("__s"), F.col(ordinal).alias("__o"), F.struct(*[c for c in stacks.columns if c != score]).alias("stack"))
    return measures.join(s, (F.col(score) == F.col("__s")) & (F.col(written) + first == F.col("__o")), "left").drop("__s", "__o")


def place_staves(staves: DataFrame, page_staves: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The staves found on the page by ``keys`` (system, part within the movement, staff number), and those that aren't, each once."""
    found = staves.join(page_staves, keys)
    return found, staves.join(page_staves.select(*keys), keys, "left_anti").select(*keys).distinct()
