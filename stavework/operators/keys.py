"""Keys of staves: the stretches that should share one, and readings that differ from the ensemble's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.operators.windows import in_force, row_before, running_sum


def stretches(measures: DataFrame, staff: list[str], order: list[str]) -> DataFrame:
    """Each measure with its key in force, its segment and its stretch, numbered from 1 within the staff.

    ``measures(staff..., order..., fifths, new_piece, at_system, double_bar)``: ``fifths`` only where a key is read,
    ``double_bar`` at its left or at the right of the measure before. A piece's first measure begins a stretch; a key that
    changes within a system or after a double bar is printed as a change and begins one too. A system's first measure
    and any change begin a segment. Before the first reading 0 is in force; null flags are false.
    """
    d = in_force(measures, staff, order, "fifths", "key", 0)
    d = in_force(d, staff, order, "fifths", "__before", 0, before=True)
    d = row_before(d, staff, order, order[0], "__row")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    changed = F.col("fifths").isNotNull() & (F.col("fifths") != F.col("__before"))
    piece = yes("new_piece") | F.col("__row").isNull()
    stretch = piece | changed & (~yes("at_system") | yes("double_bar"))
    d = d.withColumn("__s", stretch.cast("int")).withColumn("__g", (piece | changed | yes("at_system")).cast("int"))
    d = running_sum(running_sum(d, staff, order, "__s", "stretch"), staff, order, "__g", "segment")
    return d.drop("__before", "__row", "__s", "__g")


def differing_runs(readings: DataFrame, majority: DataFrame, score: str, part: str, column: str, value: str) -> DataFrame:
    """(score, part, first, last, majority): the longest runs in which a part's reading differs from one unchanged majority.

    ``readings(score, part, column, value)`` has the key in force, ``majority(score, column, majority)`` that of the ensemble, null
    where there is none. A run next to a turn of the majority, at its first column or behind its last, is left out.
    """
    m = row_before(majority.select(score, column, "majority"), [score], [column], "majority", "__m")
    m = m.withColumn("turn", F.col("__m").isNotNull() & ~F.col("majority").eqNullSafe(F.col("__m.v"))).drop("__m")
    after = m.select(score, (F.col(column) - 1).alias(column), F.col("turn").alias("turn_after"))
    d = readings.select(score, part, column, value).join(m, [score, column]).join(after, [score, column], "left")
    d = d.withColumn("differs", F.coalesce(F.col(value) != F.col("majority"), F.lit(False))).withColumn("__d", F.struct("differs", "majority"))
    keys, order = [score, part], [column]
    d = row_before(d, keys, order, "__d", "__before")
    again = F.coalesce(F.col("__before.v.differs") & (F.col("__before.v.majority") == F.col("majority")), F.lit(False))
    d = running_sum(d.withColumn("__new", (F.col("differs") & ~again).cast("int")), keys, order, "__new", "__run").filter("differs")
    runs = d.groupBy(score, part, "__run").agg(
        F.min(column).alias("first"), F.max(column).alias("last"), F.first("majority").alias("majority"), F.min_by("turn", column).alias("__a"), F.max_by("turn_after", column).alias("__b")
    )
    return runs.filter(~F.col("__a") & ~F.coalesce("__b", F.lit(False))).drop("__run", "__a", "__b")
