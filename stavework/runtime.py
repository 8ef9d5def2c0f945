"""Session-level helpers: lineage cuts that survive lost executors, table loading, salted ranks."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (tests) a folder of this machine.

    A folder of one machine holds a part of each table only, so a cluster without a shared folder is an error.
    """
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="stavework-")
    return "file://" + _own_dir


def materialize(df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A written table is columnar and compressed, is read by every later job instead of being computed again,
    and is still there when an executor is lost. ``drop_table`` frees it early; else it goes with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stavework/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stavework_path = path  # type: ignore[attr-defined]
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table written by ``materialize`` that no later step reads."""
    path = getattr(df, "_stavework_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            pass
    if _own_dir and os.path.isdir(_own_dir):
        import shutil

        shutil.rmtree(_own_dir, ignore_errors=True)


class Shared:
    """A Python object that every worker process reads once, sent as a broadcast of its own pickled form."""

    def __init__(self, spark: SparkSession, value: object):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value: object = None

    def __getstate__(self) -> dict:
        return {"_sent": self._sent, "_value": None}

    @property
    def value(self):  # noqa: ANN201
        if self._value is None:
            self._value = cloudpickle.loads(self._sent.value)
        return self._value


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per ``key``: the one largest by ``order``, then by the row's remaining columns.

    One aggregate with map-side combine, so a key delivered many times is never gathered in one task. Its buffer is a
    struct, so Spark sorts by the key on either side of the shuffle; a hash aggregate would need the largest time
    first and then a join with all rows, which sorts and shuffles more. Rows with a null key count as one key. Maps can't be compared; such columns must be dropped before.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    row = F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]])
    out = df.groupBy(key).agg(F.max(row).alias("__row"))
    return out.select(*[F.col(f"`{c}`") if c == key else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def salted_rank(df: DataFrame, keys: list[str], order: Column, name: str = "rank", buckets: int = 512) -> DataFrame:
    """1-based rank of the rows of each key in a random but repeatable order, without one task per key.

    Rows are spread over ``buckets`` by a hash of ``order``; ranks are counted within (key, bucket) and shifted by
    the counts of the buckets before. The counts table has at most keys x buckets rows, and a key that holds a
    third of all rows is cut into ``buckets`` windows. Ties in ``order`` are ranked in any order.
    """
    b = df.withColumn("__b", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    shift = shift.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__kb"), "__shift")
    within = b.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(F.xxhash64(order, F.lit(7)), order)))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    cond = F.col("__b") == F.col("__kb")
    for x in on:
        cond = cond & x
    return within.join(shift, cond, "left").withColumn(name, F.col("__r") + F.col("__shift")).select(*df.columns, name)


#: A key with more than one row in so many is hot: there are at most so many hot keys, so their rows of a table by key can be broadcast.
HOT_SHARE = 1000


def join_by_key(rows: DataFrame, by_key: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of many rows with a table of one row a key, without a task that gets all rows of a hot key.

    ``by_key`` has the columns ``keys`` under the names ``k_<key>``, and in ``count`` how many of ``rows`` the key has, of
    ``total`` in all. Hot keys, fewer than HOT_SHARE by their definition, are joined by broadcast where their rows lie;
    the rows of the others are shuffled by key. Null keys meet null keys. There must be a key.
    """
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
    is_hot = F.col(count) * HOT_SHARE > total
    hot, cold = by_key.filter(is_hot), by_key.filter(~is_hot)
    marks = hot.select(*[F.col(f"k_{k}").alias(f"h_{k}") for k in keys])
    hot_row = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"h_{k}")) for k in keys])
    rest = rows.join(F.broadcast(marks), hot_row, "left_anti")
    return rows.join(F.broadcast(hot), same).unionByName(rest.join(cold, same)).drop(*[f"k_{k}" for k in keys])
