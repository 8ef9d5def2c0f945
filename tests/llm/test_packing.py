"""Packing: every item once, no container too full, none cut without need, little room left."""

import os

import pytest
from pyspark.sql import functions as F

from stavework.llm.packing import VOCABULARY, Packer, count_tokens, pack


def test_pack(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("units"))
    df = df.union(spark.createDataFrame([(9001, 0), (9002, None), (9003, 450), (9004, 200), (9005, 201), (9005, 201)], "key bigint, units bigint"))
    out = pack(df, "key", "units", {"small": 100, "big": 1000}, block=1000).cache()
    for kind, c in (("small", 100), ("big", 1000)):
        o = out.filter(F.col("container_kind") == kind)
        fill = o.groupBy("container").agg(F.sum("units").alias("u"))
        assert fill.agg(F.max("u")).first()[0] <= c
        total = df.agg(F.sum("units")).first()[0]
        assert o.agg(F.sum("units")).first()[0] == total
        assert fill.filter("u > 0").count() <= total / c * 1.04 + 1
        assert o.select("key").distinct().count() == df.select("key").distinct().count()
        cut = o.groupBy("key", "piece").count().filter("count > 1").select("key").distinct().collect()
        assert {r.key for r in cut} <= {9005}  # a repeated row is another item
    assert [r.units for r in out.filter("container_kind = 'small' AND key = 9003").orderBy("piece").collect()] == [100, 100, 100, 100, 50]
    assert [r.units for r in out.filter("container_kind = 'small' AND key = 9004").orderBy("piece").collect()] == [100, 100]
    other = pack(df.repartition(7).orderBy(F.rand(3)), "key", "units", {"small": 100, "big": 1000}, block=1000)  # stored in another way
    assert sorted(map(str, out.collect())) == sorted(map(str, other.collect()))
    assert pack(df.filter("key < 0"), "key", "units", {"small": 100}).count() == 0
    with pytest.raises(ValueError):
        pack(df, "key", "units", {"none": 0})
    assert pack(df, "key", "units", {}).count() == 0


def test_equal_items(spark):
    df = spark.range(25_000).select(F.lit(1).alias("key"), F.lit(3).alias("units"))
    out = pack(df, "key", "units", {"c": 10})
    assert out.count() == 25_000 and out.groupBy("container").agg(F.sum("units").alias("u")).filter("u > 10").isEmpty()


def test_sum_of_squares():
    """Each placement has the least sum of squares of all."""
    import random

    rng, c = random.Random(4), 12
    p = Packer(c)
    for _ in range(400):
        before, size = p.gaps.copy(), rng.randrange(1, c + 1)
        p.place(size)

        def after(h, n=before, s=size):
            m = n.copy()
            if h < c:
                m[h] -= 1
            if h > s:
                m[h - s] += 1
            return int((m[1:] ** 2).sum())

        options = [after(h) for h in range(size, c) if before[h]] + [after(c)]
        assert int((p.gaps[1:] ** 2).sum()) == min(options)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")
def test_tokens(spark):
    long = "word " * 50_000
    df = spark.createDataFrame([("a b",), ("",), (None,), (long,), ("<|endoftext|>",)], "text string")
    n = [r.tokens for r in count_tokens(df, "text").collect()]
    assert n[:3] == [2, 0, 0] and n[3] >= 50_000 and n[4] > 1
