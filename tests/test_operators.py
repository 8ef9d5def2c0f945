"""Operators on small fixtures with nulls, ties, repeated rows and empty tables."""

from pyspark.sql import functions as F

from stavework.operators import aggregates, calibration, matching, sets, state, windows
from stavework.runtime import latest, salted_rank


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_latest_and_rank(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 3, None), (1, 3, "b"), (None, 1, "c"), (None, 1, "c"), (2, None, "d")], "k int, t int, v string")
    assert sorted(rows(latest(df, "k", "t")), key=str) == [(1, 3, "b"), (2, None, "d"), (None, 1, "c")]
    big = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 > 0, 1).otherwise(F.lit(None)))
    got = salted_rank(big, ["k"], F.col("id")).groupBy("k").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.countDistinct("rank").alias("c"))
    assert sorted(rows(got), key=str) == [(1, 1, 666, 666), (None, 1, 334, 334)]
    assert salted_rank(big.filter("id < 0"), ["k"], F.col("id")).count() == 0


def test_windows(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 5), ("a", 2, None), ("a", 3, 5), ("a", 4, 6), ("b", 0, None)], "k string, i int, v int")
    assert [r[3] for r in rows(windows.in_force(df, ["k"], ["i"], "v", "f", 0), "k", "i")] == [0, 5, 5, 5, 6, 0]
    assert rows(windows.turns(df, ["k"], ["i"], "v"), "i") == [("a", 1, 5), ("a", 2, None), ("a", 3, 5), ("a", 4, 6)]
    assert [r[2] for r in rows(windows.drop_restated(df, ["k"], ["i"], "v"), "k", "i")] == [None, 5, None, None, 6, None]
    assert rows(windows.equal_triples(spark.createDataFrame([("a", i, 1) for i in range(4)], "k string, i int, v int"), ["k"], ["i"], "v"), "i") == [("a", 0, 1), ("a", 1, 1)]
    r = spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("a", 6, 7), ("a", 7, 7), ("b", 0, 0)], "k string, s int, e int")
    assert rows(windows.merge_ranges(r, ["k"], "s", "e"), "k", "s") == [("a", 1, 4, 2), ("a", 6, 7, 2), ("b", 0, 0, 1)]
    assert windows.merge_ranges(r.filter("s < 0"), ["k"], "s", "e").count() == 0
    g = spark.createDataFrame([("a", 0, True, 1), ("a", 1, False, 2), ("a", 2, True, 3)], "k string, i int, g boolean, v int")
    assert [x[4] for x in rows(windows.with_next_plain(g, ["k"], ["i"], "g", "v", "n"), "i")] == [2, 2, None]
    clefs = spark.createDataFrame([("a", 0, 0, "G"), ("a", 1, 5, "F")], "k string, m_idx int, offset_ticks int, clef string")
    ev = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 4, 2), ("a", 1, 5, 3), ("a", 2, 0, 4)], "k string, m_idx int, offset_ticks int, id int")
    assert [(x.id, x.clef) for x in windows.clef_in_force(clefs, ev, ["k"]).orderBy("id").collect()] == [(1, "G"), (2, "G"), (3, "F"), (4, "F")]
    f = windows.folds(spark.createDataFrame([("x",), ("y",), (None,), ("x",), ("z",)], "g string"), "g", 2)
    assert sorted(rows(f), key=str) == [("x", 1), ("x", 1), ("y", 0), ("z", 1), (None, 0)]
    p = spark.createDataFrame([(1, 0, 0, "down"), (1, 1, 0, "stop"), (1, 2, 1, "up"), (1, 3, 5, "stop"), (2, 0, 0, "stop")], "k int, i int, sys int, kind string")
    assert [(x.k, x.i, x.stop_row.i if x.stop_row else None) for x in windows.pair_shifts(p, ["k"], ["i"], "kind", "sys").orderBy("k", "i").collect()] == [(1, 0, 1), (1, 2, None), (1, 3, 3), (2, 0, 0)]


def test_systems(spark):
    box = lambda p, x, y: (p, float(x), float(y), 10.0, 10.0)
    df = spark.createDataFrame([("a", 0, box(0, 0, 0)), ("a", 1, None), ("a", 2, box(0, 50, 0)), ("a", 3, box(0, 0, 40)), ("a", 4, box(1, 10, 40))], "k string, i int, bbox struct<page:int,x:double,y:double,w:double,h:double>")
    assert [r.system for r in windows.systems(df, ["k"], ["i"]).orderBy("i").collect()] == [0, 0, 0, 1, 2]
    assert [r.system for r in windows.systems_by_height(df, ["k"], ["i"]).orderBy("i").collect()] == [0, 1, 2, 3, 4]


def test_votes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", None)], "k string, v int")
    assert rows(aggregates.vote(df, ["k"], "v"), "k") == [("a", 1), ("b", None)]
    assert rows(aggregates.vote(df, ["k"], "v", F.col("v")), "k") == [("a", 1), ("b", 2)]
    assert rows(aggregates.bounded_mode(df, ["k"], "v", 1, 2), "k") == [("a", 1), ("b", 1)]
    m = df.withColumn("o", F.monotonically_increasing_id())
    assert rows(aggregates.majority(m, ["k"], "v", "o"), "k") == [("a", 1), ("b", None), ("c", None)]
    parts = spark.createDataFrame([("s", 0, 8, 0.5), ("s", 1, 8, 0.9), ("s", 2, 9, 1.0), ("t", 0, 3, None), ("t", 1, 4, None), ("t", 2, 5, 1.0)], "s string, p int, n int, c double")
    assert rows(aggregates.reference_part(parts, ["s"], "p", "n", "c"), "s") == [("s", 1, 8), ("t", 1, 4)]
    o = spark.createDataFrame([("a", True), ("a", False), ("a", True), ("b", False)], "k string, f boolean")
    assert sorted(round(r[2], 3) for r in rows(aggregates.others_share(o, ["k"], "f", "x"))) == [0.5, 0.5, 1.0, 1.0]


def test_bags(spark):
    a = spark.createDataFrame([("k", "x"), ("k", "x"), ("k", None)], "k string, t string")
    b = spark.createDataFrame([("k", "x"), ("k", None), ("k", None), ("j", "y")], "k string, t string")
    assert rows(aggregates.bag_overlap(a, b, ["k"], "t"), "k") == [("j", 0, 1, 0), ("k", 3, 3, 2)]
    p = a.withColumn("i", F.monotonically_increasing_id())
    assert sorted(r[3] for r in rows(aggregates.claimed(p, b, ["k"], ["t"], ["i"]))) == [False, True, True]
    assert rows(spark.range(1).select(*aggregates.precision_recall(F.lit(0), F.lit(0), F.lit(0)))) == [(0.0, 0.0, 0.0)]
    g = aggregates.overlapping_groups(a, {"": F.lit("all"), "t": F.col("t")}, [F.count(F.lit(1)).alias("n")])
    assert rows(g, "grp") == [("all", 3), ("t:x", 2)]


def test_matching(spark):
    left = spark.createDataFrame([(1, "k", 5.0), (2, "k", 50.0), (3, "j", 1.0)], "id int, k string, at double")
    right = spark.createDataFrame([(1, "k", 4.0), (2, "k", 6.0), (3, "k", 53.5)], "o int, k string, x double")
    got = matching.nearest(left, right, ["k"], "at", "x", 3.0, "o", "id").orderBy("id").collect()
    assert [(r.id, r.nearest.o if r.nearest else None) for r in got] == [(1, 1), (2, None), (3, None)]
    boxes = spark.createDataFrame([(1, "k", (0, 0.0, 0.0, 300.0, 300.0))], "b int, k string, box struct<page:int,x:double,y:double,w:double,h:double>")
    pts = spark.createDataFrame([(1, "k", 299.0, 300.0), (2, "k", 301.0, 0.0)], "id int, k string, px double, py double")
    assert [r.id for r in matching.inside(pts, boxes, ["k"], "px", "py", "box").collect()] == [1]
    t = [("s", "truth", i, list("abc")) for i in range(4)] + [("s", "truth", 4, list("xyz"))]
    pred = [("s", "pred", i, list("abc")) for i in range(3)] + [("s", "pred", 3, list("xyz"))]
    lost = spark.createDataFrame([("u", "truth", 0, ["a", "b"])], "k string, side string, m_idx int, tokens array<string>")
    c = matching.compare_staves(spark.createDataFrame(t + pred, lost.schema).union(lost), "k")
    assert rows(c.select("k", "measures", "events", "exact", "edits"), "k") == [("s", 5, 15, 4, 3), ("u", 1, 2, 0, 2)]
    base = spark.createDataFrame([("s", 0, "Flute", 1), ("s", 1, "Piano", 2)], "s string, part_ord int, name string, n_staves int")
    mv = spark.createDataFrame([("s", 0, "Fl.", 1), ("s", 1, "Oboe", 1), ("s", 2, "Piano", 2)], base.schema)
    assert rows(matching.continue_parts(base, mv, "s"), "part_ord") == [("s", 0, 0), ("s", 1, None), ("s", 2, 1)]
    n = spark.createDataFrame([("g", 1, 0, 1.0, 3, False), ("g", 2, 0, 1.2, 3, False), ("g", 3, 0, 9.0, 0, False)], "g string, ev bigint, head_ord int, x double, step int, grace boolean")
    h = spark.createDataFrame([("g", 7, 1.1, 3, 0.9), ("g", 8, 2.0, 4, 0.8)], "g string, head_id bigint, x double, step int, confidence double")
    assert [(r.ev, r.head_id, r.exact) for r in matching.locate_heads(n, h, ["g"]).orderBy("ev").collect()] == [(1, 7, True), (2, 8, False), (3, None, False)]


def test_sets_and_state(spark):
    m = spark.createDataFrame([("s", 0, 0), ("s", 0, 1), ("s", 0, 2), ("s", 1, 0)], "score_id string, staff int, m_idx int")
    assert rows(sets.missing_measures(m, ["score_id", "staff"]), "m_idx") == [("s", 1, 1), ("s", 1, 2)]
    assert [r.m_idx for r in sets.append_movement(m, m.filter("staff = 1")).orderBy("m_idx").collect()] == [0, 0, 1, 2, 3]
    v = spark.createDataFrame([("s", i, float(h) if h else None) for i, h in enumerate([60, 72, 50, 65, None])], "s string, v int, h double")
    assert rows(sets.loudest_voices(v, ["s"], "h", "v").select("v", "place"), "place") == [(1, 1), (3, 2), (0, 3), (4, 4)]
    u = spark.createDataFrame([(1, 1, "queued", None), (1, 2, "running", "e"), (1, 3, None, None), (2, 1, "done", None)], "job int, at int, status string, error string")
    s = state.current(u, "job", ["at"], ["status", "error"])
    assert rows(s, "job") == [(1, "running", "e"), (2, "done", None)]
    assert [r.status for r in state.recover(s).orderBy("job").collect()] == ["failed", "done"]
    assert rows(state.best_candidate(spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, 2.0)], "k int, o int, s double"), ["k"], "s", "o")) == [(1, 1, 2.0)]
    steps = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True)], "j int, o int, ok boolean")
    assert rows(state.stopped_at(steps, "j", "o", "ok"), "o") == [(1, 0, True), (1, 1, False)]


def test_calibration(spark):
    df = spark.createDataFrame([(0.45, True), (0.95, True), (1.0, False), (None, True), (float("nan"), False), (0.5, False)], "p double, y boolean")
    b = {r.band: (r.n, r.accuracy) for r in calibration.by_band(df, "p", "y").collect()}
    assert b == {"0.0-0.5": (1, 1.0), "0.9-1.0": (2, 0.5), "0.5-0.7": (1, 0.0), None: (2, 0.5)}
    assert calibration.pool_adjacent([(0.1, 0.2, 1), (0.2, 0.1, 1), (0.3, 0.5, 2)]) == [(0.15000000000000002, 0.15000000000000002), (0.3, 0.5)]
    pts = [(0.2, 0.1), (0.4, 0.5), (0.4, 0.6)]
    x = spark.createDataFrame([(0.0,), (0.3,), (0.4,), (0.9,)], "p double").select(calibration.piecewise(F.col("p"), pts))
    assert [round(r[0], 6) for r in x.collect()] == [0.1, 0.3, 0.5, 0.6]
    d = spark.createDataFrame([([float(i % 7), float(i % 3)], i % 7 > 3, f"g{i % 5}") for i in range(200)], "x array<double>, y boolean, g string")
    out = calibration.out_of_fold(d, "x", "y", "g", 2)
    assert out.count() == 200 and out.filter("y").agg(F.avg("score")).first()[0] > out.filter("NOT y").agg(F.avg("score")).first()[0]
    assert len(calibration.fit_isotonic(out, "score", "y")) >= 1
