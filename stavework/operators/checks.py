"""Checks of scores: rhythm, range, alignment, lyrics; the review list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions import music, text
from stavework.operators.windows import in_force
from stavework.runtime import join_by_key

STAFF = ["score_id", "part_ord", "staff_no"]
#: What each kind of issue adds to a measure's priority.
WEIGHTS = {"compile": 5.0, "bar-check": 3.0, "rhythm": 3.0, "range": 2.0, "repaired": 1.0, "low-confidence": 1.0}
LOW_CONFIDENCE = 0.5


def voice_lengths(events: DataFrame) -> DataFrame:
    """A2, A3: of each voice in each measure the sum of durations and the last end, in ticks, grace notes aside."""
    plain = ~F.col("grace")
    return events.groupBy(*STAFF, "m_idx", "voice_no").agg(
        F.coalesce(F.sum(F.when(plain, F.col("duration_ticks"))), F.lit(0)).alias("total"),
        F.greatest(F.coalesce(F.max(F.when(plain, F.col("offset_ticks") + F.col("duration_ticks"))), F.lit(0)), F.lit(0)).alias("end"),
    )


def measure_label(number: Column, index: Column) -> Column:
    """The printed number, else the place counted from 1."""
    return F.coalesce(F.nullif(number, F.lit("")), (index + 1).cast("string"))


def rhythm_check(measures: DataFrame, voices: DataFrame) -> DataFrame:
    """A4, card E: voices that don't fill the time in force.

    ``measures(score_id, part_ord, staff_no, m_idx, m_number, implicit, measure_ticks)`` with ``measure_ticks`` only
    where a time is stated; ``voices`` as from ``voice_lengths``. A first measure marked as a pickup may be shorter; the
    last may lack what the pickup holds; without a time nothing is checked.
    """
    m = in_force(measures, STAFF, ["m_idx"], "measure_ticks", "expected")
    v = m.filter("expected IS NOT NULL").join(voices, [*STAFF, "m_idx"])
    short = (F.col("m_idx") == 0) & (F.col("total") < F.col("expected")) & (F.coalesce("implicit", F.lit(False)) | F.coalesce(F.col("m_number") == "0", F.lit(False)))
    v = v.withColumn("__pickup", short)
    # of each staff its last measure and what its pickup holds, of several voices' the last
    staff = [F.col(k).alias(f"k_{k}") for k in STAFF]
    ends = measures.groupBy(*staff).agg(F.max("m_idx").alias("__end"))
    held = v.groupBy(*staff).agg(F.max(F.when(F.col("__pickup"), F.struct("voice_no", "total")))["total"].alias("__held"), F.count(F.lit(1)).alias("__n"))
    by_staff = ends.join(held, [f"k_{k}" for k in STAFF])
    v = join_by_key(v, by_staff, STAFF, "__n", by_staff.agg(F.sum("__n")).first()[0] or 0)
    v = v.withColumn("__last", F.col("m_idx") == F.col("__end")).withColumn("__held", F.coalesce("__held", F.lit(0)))
    completes = F.col("__last") & (F.col("__held") != 0) & (F.col("total") + F.col("__held") == F.col("expected"))
    bad = (F.col("total") != F.col("expected")) & ~F.col("__pickup") & ~completes
    return v.filter(bad).select(*STAFF, "m_idx", measure_label(F.col("m_number"), F.col("m_idx")).alias("measure"), "voice_no", "expected", F.col("total").alias("actual"))


def range_check(notes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A5: notes outside their part's range. ``notes`` has part_name, abbreviation, step, alter, octave and any keys.

    The patterns are matched once for each distinct name, not for each note. ``names(part_name, abbreviation)``, where
    given, holds all names at least: then the notes are read once.
    """
    names = (notes if names is None else names).select("part_name", "abbreviation").distinct().withColumn("__r", text.instrument_range(F.col("part_name"), F.col("abbreviation")))
    names = names.select(F.col("part_name").alias("__n"), F.col("abbreviation").alias("__a"), "__r.*")
    d = notes.join(names, F.col("part_name").eqNullSafe(F.col("__n")) & F.col("abbreviation").eqNullSafe(F.col("__a")))
    d = d.withColumn("midi", music.midi(F.col("step"), F.col("alter"), F.col("octave"))).filter((F.col("midi") < F.col("lo")) | (F.col("midi") > F.col("hi")))
    return d.withColumn("pitch", music.label(F.col("step"), F.col("alter"), F.col("octave"))).select(*notes.columns, "midi", "lo", "hi", "rule", "pitch")


def alignment_check(measures: DataFrame) -> DataFrame:
    """Per score one ``measure-count`` row if staves differ in length, and one ``barline`` row for each staff and
    measure whose right barline differs from the first staff's, over the shorter length."""
    counts = measures.groupBy(*STAFF).agg(F.count(F.lit(1)).alias("n"))
    uneven = counts.groupBy("score_id").agg(F.min("n").alias("a"), F.max("n").alias("b")).filter("a <> b")
    uneven = uneven.select("score_id", F.lit("measure-count").alias("kind"), F.lit(None).cast("int").alias("part_ord"), F.lit(None).cast("int").alias("staff_no"), F.lit(None).cast("int").alias("m_idx"))
    first = Window.partitionBy("score_id", "m_idx")
    head = measures.groupBy(F.col("score_id").alias("k_score_id")).agg(F.min(F.struct("part_ord", "staff_no")).alias("__ref"), F.count(F.lit(1)).alias("__n"))
    m = join_by_key(measures, head, ["score_id"], "__n", head.agg(F.sum("__n")).first()[0] or 0)
    is_ref = F.struct("part_ord", "staff_no") == F.col("__ref")
    m = m.withColumn("__bar", F.max(F.when(is_ref, F.struct(F.lit(1), F.col("right_barline")))).over(first))
    bad = m.filter(~is_ref & F.col("__bar").isNotNull() & ~F.col("right_barline").eqNullSafe(F.col("__bar.right_barline")))
    return uneven.unionByName(bad.select("score_id", F.lit("barline").alias("kind"), "part_ord", "staff_no", "m_idx"))


def lyrics_check(parts: DataFrame, lyric_events: DataFrame) -> DataFrame:
    """Parts named for instruments that have lyrics: how many events, in which measures and staves.

    ``parts(score_id, part_ord, name, abbreviation)``; ``lyric_events(score_id, part_ord, staff_no, m_idx, measure)``.
    """

    def verdict(column: str) -> Column:
        c = F.col(column)
        return F.when(F.coalesce(F.lower(F.trim(c)).isin("", "voice"), F.lit(True)), None).otherwise(text.instrument_name(c))

    instrumental = parts.filter(F.coalesce(verdict("name"), verdict("abbreviation"), F.lit(False)))
    found = instrumental.join(lyric_events, ["score_id", "part_ord"])
    per = found.groupBy("score_id", "part_ord", "staff_no", "m_idx", "measure").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("score_id", "part_ord").agg(
        F.sum("n").alias("n_events"),
        F.transform(F.array_sort(F.collect_list(F.struct("staff_no", "m_idx", "measure"))), lambda x: x["measure"]).alias("measures"),
        F.array_sort(F.collect_set("staff_no")).alias("staves"),
    )


def passed(issues: DataFrame, scores: DataFrame, score: str = "score_id") -> DataFrame:
    """Of each score whether no check found anything; ``issues`` has a row for each finding."""
    n = issues.groupBy(score).agg(F.count(F.lit(1)).alias("__n"))
    return scores.select(score).distinct().join(n, score, "left").select(score, F.col("__n").isNull().alias("passed"))


def located(diagnostics: DataFrame, measures: DataFrame, file: str, line: str, measure: str) -> DataFrame:
    """The diagnostics with the measure that the file and line stand for, of several the later; null where none does."""
    at = measures.filter(F.col(file).isNotNull() & F.col(line).isNotNull()).groupBy(file, line).agg(F.max(measure).alias("found"))
    return diagnostics.join(at, [file, line], "left")


def review(issues: Column, confidences: Column) -> Column:
    """Card N: the priority of a measure from its issues' kinds and its events' confidences.

    Low confidence counts once for each event below LOW_CONFIDENCE, not by its issue; what the least confident event
    lacks to 1 is added.
    """
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    known = F.filter(confidences, lambda c: c.isNotNull())
    by_kind = F.aggregate(issues, F.lit(0.0), lambda acc, k: acc + F.when(k == "low-confidence", 0.0).otherwise(F.coalesce(weight[k], F.lit(0.0))))
    low = F.size(F.filter(known, lambda c: c < LOW_CONFIDENCE)) * WEIGHTS["low-confidence"]
    return by_kind + low + F.coalesce(1.0 - F.array_min(known), F.lit(0.0))
