"""Grids, padding, overlap of sets, merging of movements and unisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_measures(measures: DataFrame, staff: list[str], score: str = "score_id", index: str = "m_idx") -> DataFrame:
    """The (staff, index) rows that staves lack up to their score's longest. Made per staff from a sequence, not by a cross join."""
    last = measures.groupBy(*staff).agg(F.max(index).alias("__last"))
    w = Window.partitionBy(score)
    d = last.withColumn("__most", F.max("__last").over(w)).filter(F.col("__last") < F.col("__most"))
    return d.select(*staff, F.explode(F.sequence(F.col("__last") + 1, F.col("__most"))).alias(index))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all values of two arrays; 1 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def merge_unisons(heads: DataFrame, keys: list[str]) -> DataFrame:
    """Heads of one chord with the same midi become one: ties hold if any does, the least confidence stays."""
    return heads.groupBy(*keys, "midi").agg(F.bool_or("tie_start").alias("tie_start"), F.bool_or("tie_stop").alias("tie_stop"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_heads"))


def append_movement(base: DataFrame, movement: DataFrame, score: str = "score_id", index: str = "m_idx") -> DataFrame:
    """The movement's measures after the base's: indexes move by the base's length (its longest staff)."""
    length = base.groupBy(score).agg((F.max(index) + 1).alias("__n"))
    moved = movement.join(length, score, "left").withColumn(index, F.col(index) + F.coalesce("__n", F.lit(0))).drop("__n")
    return base.unionByName(moved, allowMissingColumns=True)


def loudest_voices(voices: DataFrame, keys: list[str], height: str, voice: str, most: int = 4) -> DataFrame:
    """Voices numbered from the highest; of more than ``most`` the highest ones and the lowest stay."""
    w = Window.partitionBy(*keys)
    d = voices.withColumn("place", F.row_number().over(w.orderBy(F.desc_nulls_last(height), voice))).withColumn("__n", F.count(F.lit(1)).over(w))
    return d.filter((F.col("place") < most) | (F.col("place") == F.col("__n")) | (F.col("__n") <= most)).withColumn("place", F.least("place", F.lit(most))).drop("__n")


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose keys ``b`` doesn't have."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")
