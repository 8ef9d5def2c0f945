"""Components against union-find, names, and split totals against exhaustive search."""

import itertools
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stavework.llm import names
from stavework.llm.splits import assign_splits, choose_counts, connected_components, star_edges


def plain(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in p}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 60)]
    rng.shuffle(chain)
    star = [(100, 1000 + i) for i in range(50)]
    odd = [(None, 5), (7, None), (8, 8), (200, 201), (200, 201), (201, 200)]
    late = [(300 + i, 400 - i) for i in range(20)]
    edges = chain + star + odd + late
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {tuple(r) for r in connected_components(df).collect()} == plain(edges)
    assert connected_components(df.filter("a < -5")).count() == 0


def test_random_components(spark):
    for seed in range(2):
        rng = random.Random(seed)
        edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
        assert {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == plain(edges)


def test_star(spark):
    m = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (None, "x"), (4, None)], "n bigint, g string")
    assert [tuple(r) for r in star_edges(m, "n", "g").collect()] == [(2, 1)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 9), st.integers(1, 3), max_size=4))
def test_totals_are_the_nearest(sizes):
    total = sum(s * k for s, k in sizes.items())
    targets = {"train": total - total // 3, "test": total // 3}
    got = choose_counts(sizes, targets)
    assert {s: sum(got[n].get(s, 0) for n in targets) for s in sizes} == sizes
    reach = {sum(s * n for s, n in zip(sizes, c)) for c in itertools.product(*[range(k + 1) for k in sizes.values()])}
    best = min(abs(t - targets["test"]) for t in reach)
    assert abs(sum(s * n for s, n in got["test"].items()) - targets["test"]) == best


def test_large_components_are_shared_in_proportion():
    for singles in (20_000, 20_000_000):
        got = choose_counts({singles // 200: 50, 1: singles}, {"train": singles, "test": singles // 4})
        assert got["test"] == {singles // 200: 10, 1: singles // 5}
    rng = random.Random(4)
    sizes = dict(Counter(int(10 ** (rng.random() * 7)) for _ in range(3000)))
    total = sum(s * k for s, k in sizes.items())
    got = choose_counts(sizes, {"a": total - 2 * (total // 10), "b": total // 10, "c": total // 10})
    large = {n: sum(s * k for s, k in g.items() if s > 1_000_000) for n, g in got.items()}
    assert all(sum(s * k for s, k in got[n].items()) == total // 10 for n in "bc")
    assert all(0.05 < large[n] / sum(large.values()) < 0.15 for n in "bc")


def test_assign(spark):
    comps = spark.range(300).select(F.col("id").alias("root"), (F.col("id") % 7 + 1).alias("n"))
    out = assign_splits(comps, {"train": 0.8, "validation": 0.1, "test": 0.1})
    total = comps.agg(F.sum("n")).first()[0]
    sums = {r.split: r.n for r in out.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert out.count() == 300 and sums["test"] == round(total * 0.1) and sums["validation"] == round(total * 0.1)
    assert assign_splits(comps.filter("n > 99"), {"a": 1.0}).count() == 0


def test_names():
    assert names.persons("Pasakox,_Kabo", True) == ["pasakox|kabo"] and names.persons("Kabo_Pasakox", True) == ["pasakox|kabo"]
    assert names.persons("K.Pasakox", True) == ["pasakox|k"] and names.persons("PASAKOX,__Käbø_", True) == ["pasakox|kabo"] and names.persons("pasakox", True) == ["pasakox|"]
    assert names.persons("A,_Bo_&_Cu,_Do;_Ex,_Fy_and_Go,_Hi", True) == ["a|bo", "cu|do", "ex|fy", "go|hi"]
    assert names.persons("eng. Tonel Hupoguk", False) == names.persons("tonel.hupoguk", False) == names.persons("Hupoguk, Tonel", False) == ["hupoguk|tonel"]
    for nobody in (None, "", " ", "_", "-", "n/a", "Unknown", "Staffpress ", "anon.", "Traditional", "???"):
        assert names.persons(nobody, True) == []


def test_resolve():
    assert names.resolve(["homal", "hmoal", "hoaml", "h", ""]) == dict.fromkeys(["homal", "hmoal", "hoaml", "h", ""], "hmoal")
    r = names.resolve(["minera", "fikera", "m", "x", ""])
    assert r["minera"] != r["fikera"] and r["m"] == r["minera"] and r["x"] == "x" and r[""] is None
    assert names.resolve(["h", "k", ""]) == {"h": "h", "k": "k", "": None} and names.resolve([""]) == {"": ""}
    assert names.resolve(["fule", "tubin"]) == {"fule": "fule", "tubin": "tubin"}


def test_resolve_cut_short_at_any_size():
    many = ["".join(x) for x in itertools.product("bdfgklmn", "aeiou", "prst", "aeiou")]
    r = names.resolve([*many, "joh", "johannes", "ma", "maximo", "mauritz"])
    assert len(many) >= 500 and r["joh"] == "johannes" and r["ma"] == "ma"
    # the same persons whether or not others share the surname
    rng = random.Random(3)
    for _ in range(100):
        few = ["".join(rng.choice("xyz") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))]
        alone, among = names.resolve(few), names.resolve([*few, *many])
        assert {k: among[k] for k in alone} == alone


def nearly(a, b):
    """Restricted edit distance, by its table."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)] <= (2 if sorted(a) == sorted(b) else 1)


def test_all_near_ways_join():
    rng = random.Random(6)
    for few, long, n in ((2, 6, 40), (3, 5, 200), (4, 7, 60)) * 4:
        ways = sorted({"".join(rng.choice("abcd"[:few]) for _ in range(rng.randint(2, long))) for _ in range(n)})
        pairs = [(a, b) for a, b in itertools.combinations(ways, 2) if nearly(a, b)]
        roots = lambda edges: dict(plain([*edges, *((w, w + "!") for w in ways)]))
        assert roots(names._near_pairs(ways)) == roots(pairs)


def test_long_names():
    assert len(set(names.resolve(["x" * 20_000, "x" * 19_999 + "y", "ab"]).values())) == 2


def test_with_persons(spark):
    df = spark.createDataFrame([(1, "Ab Cdefg", None), (2, "A. Cdefg", "Cdefg"), (3, None, None), (4, "Xy Cdefg", ""), (1, "Ab Cdefg", None), (5, "", "Ab Cdefg & Xy Cdefg")], "k bigint, f string, written string")
    got = {tuple(r) for r in names.with_persons(df, "k", {"f": False, "written": True}).collect()}
    assert got == {(1, "f", "cdefg|ab"), (2, "f", "cdefg|ab"), (4, "f", "cdefg|xy"), (5, "written", "cdefg|ab"), (5, "written", "cdefg|xy")}
