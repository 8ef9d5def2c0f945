"""Jobs as an append-only table of updates: latest state, partial updates, recovery, candidate choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(updates: DataFrame, job: str, order: list[str], fields: list[str]) -> DataFrame:
    """For each job its fields as left by all updates: a null changes nothing. One aggregate, no window."""
    at = F.struct(*order)
    return updates.groupBy(job).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def recover(state: DataFrame, status: str = "status") -> DataFrame:
    """Jobs that were queued or running when the service stopped are failed."""
    return state.withColumn(status, F.when(F.col(status).isin("queued", "running"), "failed").otherwise(F.col(status)))


def newest(state: DataFrame, created: str, row: str, n: int) -> DataFrame:
    """O3: the n newest jobs, of equals the later row first."""
    return state.orderBy(F.desc(created), F.desc(row)).limit(n)


def best_candidate(runs: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """Of each key the run with the highest score, the first of equals; null scores come last."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), order)
    return runs.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def stopped_at(steps: DataFrame, job: str, order: str, ok: str) -> DataFrame:
    """T4: of each job the steps up to and with the first that failed."""
    w = Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("__bad", F.coalesce(F.bool_or(~F.col(ok)).over(w), F.lit(False))).filter("NOT __bad").drop("__bad")
