"""Matched samples and the first N of groups against plain versions."""

import random
import struct
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stavework.llm.sampling import matched_sample, swap_repair
from stavework.llm.topn import code, top_n


def test_sample(spark):
    rows = [(i, "a" if i % 2 else "b", "x" if i % 10 else None) for i in range(1000)] + [(2000 + i, None, None) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, c string, l string")
    targets = spark.createDataFrame([("a", "x", 0.30, 1), ("b", "x", 0.14, 1), ("b", None, 0.01, 5), ("z", "x", 0.2, 2), ("z", "y", 0.0, 0)], "c string, l string, share double, min_rows int")
    s = matched_sample(df, "id", [(["c", "l"], targets)])
    assert s.size == 210 and s.rows.count() == 210 and s.rows.select("id").distinct().count() == 210
    rep = {(r.c, r.l): (r.needed, r.available, r.met) for r in s.reports[0].collect()}
    assert rep == {("a", "x"): (63, 500, True), ("b", "x"): (30, 400, True), ("b", None): (5, 100, True), ("z", "x"): (42, 0, False), ("z", "y"): (0, 0, True)}
    taken = {(r.c, r.l): r["count"] for r in s.rows.groupBy("c", "l").count().collect()}
    assert taken[("a", "x")] >= 63 and taken[("b", "x")] >= 30 and taken[("b", None)] >= 5
    again = matched_sample(df, "id", [(["c", "l"], targets)])
    assert {r.id for r in again.rows.collect()} == {r.id for r in s.rows.collect()}
    none = matched_sample(df.filter("id < 0"), "id", [(["c", "l"], targets)])
    assert none.rows.count() == 0 and none.size == 0 and none.reports[0].filter("met").count() == 1
    alone = matched_sample(df, "id", [(["c"], targets.select("c", "share", "min_rows").filter("c <> 'z'")), (["l"], targets.select("l", "share", "min_rows").filter("l = 'x'"))])
    got = {r[0]: (r.needed, r.available, r.met) for rep in alone.reports for r in rep.collect()}
    assert got == {"a": (63, 500, True), "b": (32, 500, True), "x": (135, 900, True)}


def test_swaps_leave_no_swap_that_helps():
    rng = random.Random(5)
    for _ in range(300):
        n, m = rng.randrange(0, 8), rng.randrange(0, 6)
        have = [rng.randrange(0, 30) for _ in range(n)]
        meets = [tuple(sorted(rng.sample(range(m), rng.randrange(0, min(m, 2) + 1)))) for _ in range(n)]
        want = [rng.randrange(0, 15) for _ in range(m)]
        floors = [min(w, 2) for w in want]
        size = rng.randrange(0, 80)
        take = swap_repair(have, meets, want, floors, size, 1)
        assert sum(take) == min(size, sum(have)) and all(0 <= t <= h for t, h in zip(take, have))

        def worth(take):
            got = [sum(t for t, ts in zip(take, meets) if k in ts) for k in range(m)]
            loose = sum(t for t, ts in zip(take, meets) if not ts)
            return sum(2 * max(0, w - g) + max(0, g - w) for w, g in zip(want, got)) + loose, got

        now, got = worth(take)
        for a in range(n):
            for b in range(n):
                if a != b and take[a] and take[b] < have[b]:
                    other = [t - (i == a) + (i == b) for i, t in enumerate(take)]
                    then, after = worth(other)
                    assert then >= now or any(after[k] < floors[k] and after[k] < got[k] for k in range(m))


def plain_top(rows, n):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    big = float("inf")
    key = lambda r: (-r[2] if r[2] is not None and r[2] == r[2] else big, r[3] if r[3] is not None and r[3] == r[3] else big, r[4], r[0])
    return sorted(x[0] for g in groups.values() for x in sorted(g, key=key)[:n])


def test_top_n(spark):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        g = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"g{rng.randrange(300)}"
        p = rng.choice([None, float("nan"), 0.0, -1.5, 1.0, 2.0, 2.0, float("inf"), rng.random() * 1e-300, rng.random() * 1e300])
        rows.append((i * 2**33 + i, g, p, rng.choice([None, 0.1, 0.2, rng.random()]), rng.randrange(3)))
    df = spark.createDataFrame(rows, "id bigint, g string, p double, c double, m int").withColumn("row", F.lit(1)).withColumn("c0", F.lit("clash"))
    order = [("p", True), ("c", False), ("m", False), ("id", False)]
    assert sorted(r.id for r in top_n(df, ["g"], order, 3).collect()) == plain_top(rows, 3)
    assert top_n(df, ["g"], order, 3).columns == df.columns
    assert top_n(df.filter("m > 5"), ["g"], order, 3).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1.0)] * 700 + [("a", 2.0)] + [("b", 1.0)] * 2, "g string, p double")
    got = {(r.g, r.p): r["count"] for r in top_n(df, ["g"], [("p", True)], 5).groupBy("g", "p").count().collect()}
    assert got == {("a", 2.0): 1, ("a", 1.0): 4, ("b", 1.0): 2}


def test_code_of_every_type(spark):
    rng = random.Random(9)
    near_powers = [float(2.0**e * f) for e in (-1074, -1073, -1030, -1022, -1021, -3, 0, 1, 52, 53, 1000, 1023) for f in (1.0, 1 + 2**-52, 1 - 2**-53)]
    doubles = [0.0, -0.0, float("inf"), 1.7976931348623157e308, *near_powers, *(rng.uniform(-1, 1) * 10.0 ** rng.randrange(-320, 308) for _ in range(500))]
    doubles = sorted({x for y in doubles for x in (y, -y)})
    df = spark.createDataFrame([(x,) for x in doubles] + [(None,), (float("nan"),)], "d double")
    bits = {struct.pack("<d", r.d + 0.0 if r.d else 0.0) if r.d is not None and r.d == r.d else None: r.c for r in df.select("d", code(df, [("d", False)])[0].alias("c")).collect()}
    last = (1 << 63) - 1
    assert bits.pop(None) == last
    codes = [bits[struct.pack("<d", x or 0.0)] for x in doubles]
    assert codes == sorted(codes) and len(set(codes)) == len(set(doubles)) and codes[-1] == 2047 << 52
    rows = [(Decimal(x) / 100, Decimal(x) * 10**18, datetime(1969, 12, 31) + timedelta(days=x, microseconds=x), x % 2 > 0, x) for x in rng.sample(range(-5000, 5000), 300)]
    wide = spark.createDataFrame([(*r, r[2]) for r in rows] + [(None,) * 6], "a decimal(9,2), b decimal(30,0), t timestamp, y boolean, i bigint, z timestamp_ntz")
    for c in ("a", "b", "t", "z"):
        for down in (False, True):
            words = [f"w{k}" for k in range(3 if c == "b" else 1)]
            coded = wide.filter("i IS NOT NULL").select("i", *[x.alias(w) for x, w in zip(code(wide, [(c, down)]), words)])
            assert [r.i for r in coded.orderBy(*words).collect()] == [r[4] for r in sorted(rows, reverse=down)], c
    assert [r.i for r in top_n(wide, [], [("b", True)], 2).orderBy("i").collect()] == [r[4] for r in sorted(rows)[-2:]]
    with pytest.raises(TypeError):
        top_n(wide.withColumn("s", F.lit("x")), [], [("s", False)], 1)
