"""Windows in blocks against windows over whole keys; joins with hot keys; models, words and matches."""

import difflib
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stavework.functions import text
from stavework.operators import aggregates, calibration, windows
from stavework.runtime import join_by_key, shared_dir

KEYS, ORDER = ["k"], ["m_idx", "id"]


def rows(n=300):
    rng = random.Random(4)
    return [(i, rng.choice([None, "a", "hot", "hot"]), rng.randrange(60), rng.choice([None, None, "x", "y"]), rng.randrange(5)) for i in range(n)]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_blocks_equal_whole_windows(spark, monkeypatch, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    df = spark.createDataFrame(rows(), "id bigint, k string, m_idx int, v string, n int")
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    upto, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = windows.in_force(df, KEYS, ORDER, "v", "got", "none")
    d = windows.in_force(d, KEYS, ORDER, "v", "got_above", before=True)
    d = windows.row_before(d, KEYS, ORDER, "v", "got_row")
    d = windows.running_sum(d, KEYS, ORDER, "n", "got_sum")
    d = d.withColumn("w1", F.coalesce(F.last("v", True).over(upto), F.lit("none"))).withColumn("w2", F.last("v", True).over(above)).withColumn("w3", F.lag(F.struct(F.col("v").alias("v"))).over(w)).withColumn("w4", F.sum("n").over(upto))
    bad = d.filter(~(F.col("got").eqNullSafe(F.col("w1")) & F.col("got_above").eqNullSafe(F.col("w2")) & F.col("got_row").eqNullSafe(F.col("w3")) & F.col("got_sum").eqNullSafe(F.col("w4"))))
    assert d.count() == 300 and bad.count() == 0
    ranges = df.select("k", F.col("m_idx").alias("a"), (F.col("m_idx") + F.col("n")).alias("b"))
    got = sorted(map(str, windows.merge_ranges(ranges.filter("a % 9 < 4"), KEYS, "a", "b").collect()))
    plain = {}
    for r in ranges.filter("a % 9 < 4").orderBy("a", "b").collect():
        runs = plain.setdefault(r.k, [])
        if runs and r.a <= runs[-1][1]:
            runs[-1][1:] = [max(runs[-1][1], r.b), runs[-1][2] + 1]
        else:
            runs.append([r.a, r.b, 1])
    assert got == sorted(f"Row(k={k!r}, a={a}, b={b}, n={n})" for k, x in plain.items() for a, b, n in x)
    numbered = aggregates.numbered_in_order(df.select("k", "m_idx"), KEYS, "m_idx", "place").collect()
    assert sorted((r.k or "", r.place) for r in numbered) == sorted((k or "", i + 1) for k in (None, "a", "hot") for i in range(sum(r[1] == k for r in rows())))
    assert windows.in_force(df.filter("n > 9"), KEYS, ORDER, "v", "x").count() == 0


def test_join_by_key(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 2 else str(i)) for i in range(400)], "id bigint, k string")
    by = df.groupBy(F.col("k").alias("k_k")).agg(F.count(F.lit(1)).alias("n"))
    got = join_by_key(df, by, ["k"], "n", 400).collect()
    assert len(got) == 400 and {r.n for r in got if r.k == "hot"} == {sum(i % 2 and i % 7 != 0 for i in range(400))} and all(r.n == 58 for r in got if r.k is None)


def test_shared_dir():
    class Session:
        def __init__(self, master, given=None):
            self.sparkContext, self.conf = type("C", (), {"master": master})(), {"spark.checkpoint.dir": given}

    assert shared_dir(Session("local[4]")).startswith("file://") and shared_dir(Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            shared_dir(Session(master))


def test_models(spark, tmp_path):
    model = [0.5] * 23, -1.0, [(0.2, 0.1), (0.8, 0.9)]
    calibration.write_model(*model, str(tmp_path / "m.json"))
    assert calibration.read_model(str(tmp_path / "m.json")) == model
    (tmp_path / "other.json").write_text('{"features": ["grade"], "weights": [1], "bias": 0}')
    assert calibration.read_model(str(tmp_path / "other.json")) is None
    df = spark.createDataFrame([([0.0] * 23,), ([9.0] * 23,), ([1.0],), (None,)], "x array<double>")
    assert [r.p and round(r.p, 4) for r in df.select(calibration.apply_model(F.col("x"), model).alias("p")).collect()] == [round(0.1 + (0.268941 - 0.2) / 0.6 * 0.8, 4), 0.9, None, None]


def test_words(spark):
    df = spark.createDataFrame([("dol - - - ce",), ("cresc. . . .",), ("... pp ___",), ("- - - -",), ("",), (None,), ("a   b",)], "s string")
    assert [r.s for r in df.select(text.clean_continuation(F.col("s")).alias("s")).collect()] == ["dol ce", "cresc.", "pp", None, None, None, "a b"]
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    got = text.close_matches(pd.Series(["abca", None, "bb", ""]), pd.Series([words, words, [*words, None], words]), 4, 0.5)
    assert got[0] == difflib.get_close_matches("abca", words, 4, 0.5) and got[1] is None and got[2] == difflib.get_close_matches("bb", words, 4, 0.5) and got[3] == []


def test_first_seen(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "x"), (4, "a", None), (5, "b", None)], "id bigint, k string, v string")
    seen = aggregates.first_seen(df, ["k"], "v", "id", "vs")
    assert [tuple(r) for r in seen.collect()] == [("a", ["x", "y"])]
    parts = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1)], "k string, n bigint")
    assert sorted((r.k, r.n, r.vs) for r in aggregates.merged_stats(parts, ["k"], ["n"], seen).collect()) == [("a", 5, ["x", "y"]), ("b", 1, [])]
