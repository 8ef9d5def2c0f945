"""Stretches of keys, runs that differ from the ensemble, places on the page; hand cases with nulls, ties and empty tables."""

from pyspark.sql import functions as F

from stavework.operators import checks, engraving, keys, matching, placement


def test_stretches(spark):
    rows = [("a", 0, None, None, None, None), ("a", 1, 2, False, False, False), ("a", 2, 2, None, True, None), ("a", 3, -1, None, True, None), ("a", 4, 3, None, True, True), ("a", 5, None, True, True, None), (None, 0, 1, None, None, None)]
    df = spark.createDataFrame(rows, "s string, m_idx int, fifths int, new_piece boolean, at_system boolean, double_bar boolean")
    got = {(r.s, r.m_idx): (r.key, r.stretch, r.segment) for r in keys.stretches(df, ["s"], ["m_idx"]).collect()}
    assert got == {("a", 0): (0, 1, 1), ("a", 1): (2, 2, 2), ("a", 2): (2, 2, 3), ("a", 3): (-1, 2, 4), ("a", 4): (3, 3, 5), ("a", 5): (3, 4, 6), (None, 0): (1, 1, 1)}
    assert keys.stretches(df.filter("m_idx > 9"), ["s"], ["m_idx"]).count() == 0


def test_differing_runs(spark):
    majority = spark.createDataFrame([("x", c, m) for c, m in enumerate([1, 1, 1, 1, 1, 1, 2, 2, 2, None])], "score string, c int, majority int")
    readings = {1: [1, 3, 4, 1, 1, 5, 5, 2, 2, 2], 2: [1, 1, 1, 1, 1, 1, 2, 3, 2, 2], 3: [1, 1, 1, 1, 1, 1, 2, 2, 7, 7]}
    df = spark.createDataFrame([("x", p, c, v) for p, vs in readings.items() for c, v in enumerate(vs)], "score string, part int, c int, v int")
    got = sorted((r.part, r.first, r["last"], r.majority) for r in keys.differing_runs(df, majority, "score", "part", "c", "v").collect())
    # next to a turn: part 1 at 5 and 6, part 3 at 8, as the majority ends there
    assert got == [(1, 1, 2, 1), (2, 7, 7, 2)]


def test_placement(spark):
    stacks = placement.number_stacks(spark.createDataFrame([("x", 1, 5.0), ("x", 0, 9.0), ("x", 0, 2.0), ("y", 0, 1.0)], "s string, page int, x double"), "s", ["page", "x"])
    m = spark.createDataFrame([("x", 0), ("x", 1), ("x", 2), ("z", 0), (None, 0)], "s string, w int")
    got = {(r.s, r.w): r.stack and (r.stack.page, r.stack.x) for r in placement.place_measures(m, stacks, "s", "w", first=1).collect()}
    assert got == {("x", 0): (0, 9.0), ("x", 1): (1, 5.0), ("x", 2): None, ("z", 0): None, (None, 0): None}
    found, missed = placement.place_staves(m, m.filter("w = 0"), ["s", "w"])
    assert {tuple(r) for r in missed.collect()} == {("x", 1), ("x", 2), (None, 0)} and found.count() == 2


def test_lookups(spark):
    m = spark.createDataFrame([(1, "f", 3), (2, "f", 3), (3, None, 3), (4, "g", None)], "no int, file string, line int")
    d = spark.createDataFrame([("f", 3), ("f", 4), (None, 3)], "file string, line int")
    assert {(r.file, r.line): r.found for r in checks.located(d, m, "file", "line", "no").collect()} == {("f", 3): 2, ("f", 4): None, (None, 3): None}
    issues, scores = spark.createDataFrame([("x", 1)], "score_id string, n int"), spark.createDataFrame([("x",), ("y",), ("y",)], "score_id string")
    assert {tuple(r) for r in checks.passed(issues, scores).collect()} == {("x", False), ("y", True)}
    both = matching.by_ordinal(spark.createDataFrame([("x", 1, 5)], "s string, o int, v int"), spark.createDataFrame([("x", 1, 6), ("x", 2, 7)], "s string, o int, v int"), ["s"], "o", "v")
    assert {tuple(r) for r in both.collect()} == {("x", 1, 5, 6), ("x", 2, None, 7)}
    assert both.filter(F.lit(False)).count() == 0


def test_many_parts_of_one_name(spark):
    df = spark.range(710).select(F.lit("x").alias("score_id"), F.col("id").alias("part_ord"), F.when(F.col("id") < 709, "Viola").alias("name"))
    got = {r.part_ord: r.slug for r in engraving.part_slugs(df, "score_id").collect()}
    assert [got[k] for k in (0, 25, 26, 27, 701, 702, 709)] == ["viola-a", "viola-z", "viola-aa", "viola-ab", "viola-zz", "viola-703", "part"]
