"""Summaries keep their stated bound, merged in any way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stavework.llm import percentiles as pct


def rank_error(values, q, got):
    v = np.sort(values)
    r = max(1, int(np.ceil(q * len(v))))
    lo, hi = np.searchsorted(v, got, "left") + 1, np.searchsorted(v, got, "right")
    return max(0, lo - r, r - hi) / len(v)


@pytest.mark.parametrize("kind", ["uniform", "sorted", "equal", "heavy"])
def test_bound(kind):
    rng = np.random.default_rng(3)
    x = {"uniform": rng.random(50_000), "sorted": np.arange(50_000.0), "equal": np.ones(50_000), "heavy": rng.standard_cauchy(50_000)}[kind]
    parts = []
    for chunk in np.array_split(x, 17):
        s = pct.Summary(64)
        for c in np.array_split(chunk, 3):
            s.add(c)
        parts.append(s)
    whole = pct.Summary(64)
    for s in parts:
        whole.merge(pct.Summary.of(*s.row(), 64))
    n, _, weights, buffers = whole.row()
    assert n == len(x) == sum(w * 64 for w in weights) + len(buffers) - 64 * len(weights)
    for q in (0, 0.01, 0.25, 0.5, 0.75, 0.99, 1):
        assert rank_error(x, q, whole.quantiles([q])[0]) <= whole.err / whole.n
    assert whole.err / whole.n < 0.15


def test_few_values_are_exact():
    s = pct.Summary(64)
    s.add(np.array([3.0, 1.0, 2.0]))
    assert (s.quantiles([0, 0.5, 1]), s.err) == ([1.0, 2.0, 3.0], 0)


def test_tables(spark):
    df = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") % 5).alias("day"), F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("v"), F.lit("x").alias("n"))
    df = df.union(df.limit(1).select(F.lit(None), F.lit(0), F.lit(7.0), F.lit("x")))
    days = pct.summarise(df, ["k", "day"], "v", 128)
    out = pct.percentiles(pct.combine(days, ["k"], 128), {"p25": 0.25, "median": 0.5}, 128).collect()
    assert len(out) == 4
    for r in out:
        v = [x.v for x in df.filter(F.col("k").eqNullSafe(r.k)).select("v").collect() if x.v is not None and x.v == x.v]
        assert r.n_values == len(v) and rank_error(np.array(v), 0.5, r.median) <= r.rank_error + 1e-12
    assert pct.percentiles(pct.summarise(df.filter("day > 9"), ["k"], "v"), {"m": 0.5}).count() == 0
    assert pct.summarise(df.filter("v IS NULL"), ["k"], "v").count() == 0
    whole = pct.percentiles(pct.summarise(df, [], "v", 128), {"median": 0.5}, 128).first()
    assert whole.n_values == sum(r.n_values for r in out)


def test_many_small_summaries_of_one_key_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(pct, "FAN", 2)
    df = spark.range(0, 9_000, 1, 23).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").cast("double").alias("v"))
    out = {r.k: r for r in pct.percentiles(pct.summarise(df, ["k"], "v", 512), {"median": 0.5}, 512).collect()}
    values = np.array([float(i) for i in range(9_000) if i % 3])
    assert len(out) == 3001 and out["hot"].n_values == 6_000 and rank_error(values, 0.5, out["hot"].median) <= out["hot"].rank_error < 0.05
    assert (out["3"].median, out["3"].rank_error) == (3.0, 0.0)
