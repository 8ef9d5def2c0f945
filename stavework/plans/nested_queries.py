"""Queries of problem 5: flat tables from nested review payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.operators.nested import flatten_nested, level_table
from stavework.runtime import latest, load


def _nodes(spark: SparkSession, sf_dir: str, values: bool = True) -> DataFrame:
    raw = load(spark, sf_dir, "raw_review").select("record_id", "received_at", "payload")
    return flatten_nested(latest(raw, "record_id", "received_at", "payload"), "record_id", "payload", values=values)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, values=False).select("record_id", "node_level", "node_path")


def _level(level: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return level_table(_nodes(spark, sf_dir), level, "record_id")

    return q


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).groupBy("node_level", "parent_level").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "p5_found": p5_found,
    "p5_staves": _level("staff"),
    "p5_measures": _level("measure"),
    "p5_events": _level("event"),
    "p5_pitches": _level("pitch"),
    "p5_boxes": _level("bbox"),
    "p5_issues": _level("issue"),
}
ORACLES: dict[str, str] = {}
