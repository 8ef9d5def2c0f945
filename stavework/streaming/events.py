"""Streams of recorded events: windowed counts with late data, running state, exactly-once sinks.

The reference has none; these are the streaming form of the batch aggregates over measures and events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicate(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Rows delivered again within ``late`` dropped; the state is bounded by the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, keys: list[str], at: str, width: str, late: str, value: str) -> DataFrame:
    """Count and mean of a value by tumbling window and keys; rows later than ``late`` are dropped by the watermark."""
    d = stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return d.select(F.col("window.start").alias("start"), *keys, "n", "mean")


def changes(stream: DataFrame, key: str, status: str) -> DataFrame:
    """Rows at which a key's status differs from the one before, with state kept across batches."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        old = state.get[0] if state.exists else None
        rows = []
        for pdf in batches:
            for s in pdf[status]:
                if s != old:
                    rows.append((k[0], old, s))
                    old = s
        state.update((old,))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "before", "after"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, before string, after string", "old string", "append", "NoTimeout")


def write_once(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d):  # noqa: ANN201
    """All that is there, once: each batch goes to its own folder, which a repeat of the batch overwrites."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
