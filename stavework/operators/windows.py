"""Operators over measures and events in order: values in force, runs, pairs and relaid onsets.

All take keys that name one staff or voice and the columns that order it. A part may hold a tenth of all measures, so what
looks back over a staff works in blocks of BLOCK places of the first order column, which must be a number: windows lie
within (keys, block), and what a block hands on to the next (a last value, a sum, a largest end) is aggregated to one row
a block, carried along these few rows, and joined back. Staves of one block have nothing to hand on and take no part in
the join, so it is small unless most staves are long. Windows over the keys of one voice of one measure need no blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the first order column in a block.
BLOCK = 4096


def _blocks(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(order[0]) / BLOCK))


def _handed_on(d: DataFrame, keys: list[str], order: list[str], last: Column, carried: Column, none: object = None) -> DataFrame:
    """Adds ``__c``: what the blocks before hand on. ``last`` aggregates a block, ``carried`` is aggregated over the blocks before."""
    names = [f"__k{i}" for i in range(len(keys))]
    block = d.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__b").alias("__kb")).agg(last.alias("__x"))
    before = Window.partitionBy(*names).orderBy("__kb").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*names).orderBy("__kb"))
    block = block.withColumn("__c", carried.over(before)).withColumn("__f", first).filter("__f > 1").drop("__x", "__f")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], F.col("__b").eqNullSafe(F.col("__kb")))
    out = d.join(block, same, "left").drop(*names, "__kb")
    return out if none is None else out.withColumn("__c", F.coalesce("__c", F.lit(none)))


def in_force(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, default: object = None, before: bool = False) -> DataFrame:
    """The last value that isn't null up to each row, or with ``before`` above it; ``default`` before the first."""
    d = _blocks(df, order).withColumn("__v", F.col(value))
    at = F.struct(*order)
    d = _handed_on(d, keys, order, F.max_by("__v", F.when(F.col("__v").isNotNull(), at)), F.last("__x", ignorenulls=True))
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    x = F.coalesce(F.last("__v", ignorenulls=True).over(w), F.col("__c"))
    return d.withColumn(name, x if default is None else F.coalesce(x, F.lit(default))).drop("__b", "__c", "__v")


def row_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds a struct with the row before's value as ``v``, null for a key's first row."""
    d = _blocks(df, order).withColumn("__v", F.struct(F.col(value).alias("v")))
    d = _handed_on(d, keys, order, F.max_by("__v", F.struct(*order)), F.last("__x"))
    return d.withColumn(name, F.coalesce(F.lag("__v").over(Window.partitionBy(*keys, "__b").orderBy(*order)), F.col("__c"))).drop("__b", "__c", "__v")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` up to each row and with it."""
    d = _handed_on(_blocks(df, order), keys, order, F.sum(value), F.sum("__x"), 0)
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.sum(value).over(w) + F.col("__c")).drop("__b", "__c")


def clef_in_force(clefs: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """The events with the clef that is active at each: the last one at or before its place, in any measure.

    ``clefs(keys..., m_idx, offset_ticks, clef)``, ``events(keys..., m_idx, offset_ticks, ...)``. A clef comes before an
    event at the same place. Null before the first clef.
    """
    cols = [c for c in events.columns if c not in (*keys, "m_idx", "offset_ticks")]
    a = clefs.select(*keys, "m_idx", "offset_ticks", F.col("clef").alias("__clef"), F.lit(0).alias("__what"))
    b = events.select(*keys, "m_idx", "offset_ticks", F.lit(1).alias("__what"), F.struct(*cols).alias("__row"))
    both = a.unionByName(b, allowMissingColumns=True)
    return in_force(both, keys, ["m_idx", "offset_ticks", "__what"], "__clef", "clef").filter("__what = 1").select(*keys, "m_idx", "offset_ticks", *[F.col(f"__row.{c}").alias(c) for c in cols], "clef")


def runs(df: DataFrame, keys: list[str], order: list[str], starts: str, name: str) -> DataFrame:
    """Numbers from 0 the runs that begin where the boolean column ``starts`` is true; the first row's flag doesn't count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flag = F.when(F.col(starts) & F.lag(F.lit(True)).over(w), 1).otherwise(0)
    return df.withColumn("__flag", flag).withColumn(name, F.sum("__flag").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__flag")


def previous(value: str | Column, keys: list[str], order: list[str], known: bool = False) -> Column:
    """The row before; with ``known`` the last one before that isn't null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if known:
        return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.lag(value).over(w)


def systems(df: DataFrame, keys: list[str], order: list[str], bbox: str = "bbox", name: str = "system") -> DataFrame:
    """Lines of a page: a new one where the page changes or x moves left of the last known box; null boxes join."""
    d = in_force(df, keys, order, bbox, "__before", before=True)
    moved = F.col(f"{bbox}.page") != F.col("__before.page")
    left = F.col(f"{bbox}.x") < F.col("__before.x")
    d = d.withColumn("__new", F.coalesce(moved | left, F.lit(False)).cast("int"))
    return running_sum(d, keys, order, "__new", name).drop("__before", "__new")


def systems_by_height(df: DataFrame, keys: list[str], order: list[str], bbox: str = "bbox", name: str = "system") -> DataFrame:
    """The other rule: a new one at a missing box on either side, a page change, or a move in y by over half the last height."""
    d = row_before(df, keys, order, bbox, "__before")
    last = F.col("__before.v")
    far = F.abs(F.col(f"{bbox}.y") - last["y"]) > F.greatest(last["h"], F.lit(1.0)) / 2
    new = F.col("__before").isNotNull() & (F.col(bbox).isNull() | last.isNull() | F.coalesce((F.col(f"{bbox}.page") != last["page"]) | far, F.lit(True)))
    return running_sum(d.withColumn("__new", new.cast("int")), keys, order, "__new", name).drop("__before", "__new")


def drop_restated(df: DataFrame, keys: list[str], order: list[str], value: str, starts: Column | None = None) -> DataFrame:
    """Null a value equal to the last one kept, unless a movement starts there."""
    d = in_force(df, keys, order, value, "__before", before=True)
    again = F.col(value).eqNullSafe(F.col("__before")) & ~(starts if starts is not None else F.lit(False))
    return d.withColumn("__again", again).withColumn(value, F.when(~F.col("__again"), F.col(value))).drop("__again", "__before")


def turns(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs, nulls taken as values, from the row before; the first row is none."""
    d = row_before(df, keys, order, value, "__before")
    return d.filter(F.col("__before").isNotNull() & ~F.col(value).eqNullSafe(F.col("__before.v"))).drop("__before")


def sequential(df: DataFrame, keys: list[str], order: list[str], start: str, length: str) -> DataFrame:
    """Of each key whether every start equals the end of the row before."""
    d = df.withColumn("__end", previous(F.col(start) + F.col(length), keys, order))
    return d.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("__end") == F.col(start), F.lit(True))).alias("is_sequential"))


def relay(df: DataFrame, keys: list[str], order: list[str], length: str, name: str, start: Column | None = None) -> DataFrame:
    """Onsets laid end to end: the start plus the lengths of the rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, (start if start is not None else F.lit(0)) + F.coalesce(F.sum(length).over(w), F.lit(0)))


def equal_triples(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that begin three equal ones in a row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__b", F.lead(value, 1).over(w)).withColumn("__c", F.lead(value, 2).over(w))
    return d.filter((F.col(value) == F.col("__b")) & (F.col(value) == F.col("__c"))).drop("__b", "__c")


def with_next_plain(df: DataFrame, keys: list[str], order: list[str], grace: str, value: str, name: str) -> DataFrame:
    """A grace row takes the value of the next row that isn't one; null where none follows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(name, F.first(F.when(~F.col(grace), F.col(value)), ignorenulls=True).over(w))


def merge_ranges(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The union of closed ranges, as few rows as can be: (keys, start, end, n)."""
    d = _handed_on(_blocks(df, [start]), keys, [start], F.max(end), F.max("__x"))
    w = Window.partitionBy(*keys, "__b").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max(end).over(w), F.col("__c"))
    d = d.withColumn("__new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int")).drop("__b", "__c")
    d = running_sum(d, keys, [start, end], "__new", "__run")
    return d.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("__run")


def equal_bins(df: DataFrame, order: list[str], bins: int = 40, name: str = "bin") -> DataFrame:
    """Rows in order in chunks of max(1, n div bins), as many as it takes.

    Ranks come from range partitions with counted offsets, so the whole is never sorted in one task.
    """
    n = df.count()
    ranked = global_rank(df, order, "__rank")
    return ranked.withColumn(name, F.call_function("div", F.col("__rank") - 1, F.lit(max(1, n // bins)).cast("bigint"))).drop("__rank")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based rank over all rows without a single-task window: range partitions, ranks within, counts before.

    ``order`` should tell rows apart. The partition counts (one row a partition) are what is broadcast.
    """
    from stavework.runtime import materialize

    parts = materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inner = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return inner.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__r") + F.col("__before")).drop("__p", "__q", "__r", "__before")


def folds(df: DataFrame, group: str, k: int, name: str = "fold") -> DataFrame:
    """Sorted groups dealt out to k folds in turn; the table of groups is ranked, not the rows."""
    groups = global_rank(df.select(group).distinct(), [group], "__rank")
    table = groups.select(F.col(group).alias("__g"), F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int").alias(name))
    return df.join(table, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def pair_shifts(df: DataFrame, keys: list[str], order: list[str], kind: str, system: str) -> DataFrame:
    """Starts and stops of octave lines of one number paired: one row for each pair, either side null if left over.

    A stop ends the open start at most one system later; a start whose stop is missing ends at its system's end, or at
    the next start. Adds ``stop_row``: the matching stop's order columns. Rows are (keys..., number in keys).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    nxt = F.lead(F.struct(F.col(kind), F.col(system), *order)).over(w)
    prv = F.lag(F.struct(F.col(kind), F.col(system))).over(w)
    d = df.withColumn("__next", nxt).withColumn("__prev", prv)
    ends = (F.col(f"__next.{kind}") == "stop") & (F.col(f"__next.{system}") - F.col(system) <= 1)
    opened = F.col(f"__prev.{kind}").isNotNull() & (F.col(f"__prev.{kind}") != "stop") & (F.col(system) - F.col(f"__prev.{system}") <= 1)
    start = d.filter(F.col(kind) != "stop").withColumn("stop_row", F.when(ends, F.struct(*[F.col(f"__next.{c}").alias(c) for c in order])))
    lone = d.filter((F.col(kind) == "stop") & ~F.coalesce(opened, F.lit(False))).withColumn("stop_row", F.struct(*order))
    return start.unionByName(lone).drop("__next", "__prev")
