"""Joins by nearness, containment and order, and alignments of two readings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions.text import names_compatible


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, x: str, within: float, order: str, row: str, bucket: float | None = None) -> DataFrame:
    """For each left row (told apart by ``row``) the nearest right row of its keys within a distance, or null.

    The first by ``order`` wins a draw. An equi-join on keys and a bucket of the width of the distance, of which a left
    row tries three: no pairs of a whole key are formed.
    """
    width = float(bucket or within or 1.0)
    r = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.floor(F.col(x) / width).alias("__b"), F.struct(*right.columns).alias("__right"))
    tried = left.withColumn("__t", F.explode(F.array(*[F.floor(F.col(at) / width) + d for d in (-1, 0, 1)])))
    cond = F.col("__t") == F.col("__b")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    pairs = tried.join(r, cond).withColumn("__d", F.abs(F.col(f"__right.{x}") - F.col(at))).filter(F.col("__d") <= within)
    best = pairs.groupBy(*[F.col(c).alias(f"__l_{c}") for c in [row]]).agg(F.min_by("__right", F.struct("__d", F.col(f"__right.{order}"))).alias("nearest"), F.min("__d").alias("distance"))
    return left.join(best, F.col(row) == F.col(f"__l_{row}"), "left").drop(f"__l_{row}")


def inside(points: DataFrame, boxes: DataFrame, keys: list[str], x: str, y: str, box: str, cell: float = 256.0) -> DataFrame:
    """Pairs of a point and a box of the same keys that holds it. Boxes are entered in the grid cells they cover."""
    span = lambda a, b: F.sequence(F.floor(a / cell).cast("bigint"), F.floor((a + b) / cell).cast("bigint"))
    c = F.col(box)
    b = boxes.select("*", F.explode(span(c["x"], c["w"])).alias("__cx")).select("*", F.explode(span(c["y"], c["h"])).alias("__cy"))
    b = b.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__cx", "__cy", F.struct(*boxes.columns).alias("box_row"))
    cond = (F.floor(F.col(x) / cell) == F.col("__cx")) & (F.floor(F.col(y) / cell) == F.col("__cy"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    r = F.col(f"box_row.{box}")
    hit = (F.col(x) >= r["x"]) & (F.col(x) <= r["x"] + r["w"]) & (F.col(y) >= r["y"]) & (F.col(y) <= r["y"] + r["h"])
    return points.join(b, cond).filter(hit).select(*points.columns, "box_row")


def locate_heads(notes: DataFrame, heads: DataFrame, group: list[str]) -> DataFrame:
    """J4 to J7, card A: notes claim the nearest free head of their staff, in event order.

    ``notes(group..., ev, head_ord, x, step, grace)``, ``heads(group..., head_id, x, step, confidence)``, x in
    interlines. A head of the same step within 2.5 is exact; else any step within 1.0, a mismatch; grace notes look left
    up to 2.0. Greedy, so one staff's measure is one task unit. A key without heads or notes leaves notes unclaimed.
    """
    kinds = dict(notes.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in group) + ", ev bigint, head_ord int, head_id bigint, exact boolean, confidence double"

    def claim(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free = {int(h): (x, s, c) for h, x, s, c in zip(b.get("head_id", []), b.get("x", []), b.get("step", []), b.get("confidence", []))}
        rows = []
        for ev, k, x, step, grace in a.sort_values(["ev", "head_ord"])[["ev", "head_ord", "x", "step", "grace"]].itertuples(index=False):
            reach = (lambda d: -2.0 <= d < 0, lambda d: -2.0 <= d < 0) if grace else (lambda d: abs(d) <= 2.5, lambda d: abs(d) <= 1.0)
            near = sorted((abs(hx - x), h, s == step) for h, (hx, s, _) in free.items() if reach[0](hx - x) and s == step) or sorted((abs(hx - x), h, False) for h, (hx, s, _) in free.items() if reach[1](hx - x))
            if near:
                _, h, exact = near[0]
                rows.append((*key, ev, k, h, exact, free.pop(h)[2]))
            else:
                rows.append((*key, ev, k, None, False, None))
        return pd.DataFrame(rows, columns=[*group, "ev", "head_ord", "head_id", "exact", "confidence"]).astype({"head_id": "Int64"})

    return notes.groupBy(*group).cogroup(heads.groupBy(*group)).applyInPandas(claim, out)


def align_scored(pairs: DataFrame, key: str) -> DataFrame:
    """J13, card D: two readings of a staff aligned measure by measure at least cost.

    ``pairs(key, side, m_idx, tokens array<string>)`` with side ``truth`` or ``pred``. Substitution costs the edit
    distance over the longer length, at most 1; a gap costs 1. Traced back preferring substitution, then a lost, then an
    added measure. Rows (key, truth_idx, pred_idx, cost). One staff pair is one group: quadratic in its measures only.
    """
    kind = dict(pairs.dtypes)[key]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = {s: [(int(m), list(t) if t is not None else []) for m, t in zip(p["m_idx"], p["tokens"])] for s, p in pdf.sort_values("m_idx").groupby("side")}
        a, b = sides.get("truth", []), sides.get("pred", [])
        memo: dict[tuple, float] = {}

        def sub(i: int, j: int) -> float:
            x, y = tuple(a[i][1]), tuple(b[j][1])
            if x == y:
                return 0.0
            if (x, y) not in memo:
                row = list(range(len(y) + 1))
                for p in range(1, len(x) + 1):
                    d, row[0] = row[0], p
                    for q in range(1, len(y) + 1):
                        d, row[q] = row[q], min(row[q] + 1, row[q - 1] + 1, d + (x[p - 1] != y[q - 1]))
                memo[x, y] = min(1.0, row[-1] / max(len(x), len(y), 1))
            return memo[x, y]

        n, m = len(a), len(b)
        cost = np.zeros((n + 1, m + 1))
        cost[:, 0], cost[0, :] = np.arange(n + 1), np.arange(m + 1)
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                cost[i, j] = min(cost[i - 1, j - 1] + sub(i - 1, j - 1), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
        rows, i, j = [], n, m
        while i or j:
            if i and j and abs(cost[i, j] - cost[i - 1, j - 1] - sub(i - 1, j - 1)) < 1e-9:
                i, j = i - 1, j - 1
                rows.append((a[i][0], b[j][0], sub(i, j)))
            elif i and abs(cost[i, j] - cost[i - 1, j] - 1) < 1e-9:
                i -= 1
                rows.append((a[i][0], None, 1.0))
            else:
                j -= 1
                rows.append((None, b[j][0], 1.0))
        out = pd.DataFrame(rows[::-1], columns=["truth_idx", "pred_idx", "cost"]).astype({"truth_idx": "Int64", "pred_idx": "Int64"})
        out.insert(0, key, pdf[key].iat[0])
        return out

    return pairs.groupBy(key).applyInPandas(one, f"{key} {kind}, truth_idx bigint, pred_idx bigint, cost double")


def compare_staves(pairs: DataFrame, key: str) -> DataFrame:
    """A23, card D: per staff pair the measures and events of the truth, exact measures, event edits, matched events.

    Unmatched measures cost all their events; without a prediction all the truth's events are edits.
    """
    steps = align_scored(pairs, key)
    t = pairs.filter("side = 'truth'").select(key, F.col("m_idx").cast("bigint").alias("truth_idx"), F.col("tokens").alias("t"))
    p = pairs.filter("side = 'pred'").select(key, F.col("m_idx").cast("bigint").alias("pred_idx"), F.col("tokens").alias("p"))
    from stavework.functions.text import edit_distance

    d = steps.join(t, [key, "truth_idx"], "left").join(p, [key, "pred_idx"], "left").withColumn("edits", edit_distance(F.coalesce("t", F.array()), F.coalesce("p", F.array())))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(n(c))
    return d.groupBy(key).agg(
        F.count("truth_idx").alias("measures"), F.sum(size("t")).alias("events"), F.sum(((F.col("t").isNotNull()) & (F.col("p").isNotNull()) & (F.col("edits") == 0)).cast("int")).alias("exact"), F.sum("edits").alias("edits"),
    )


def continue_parts(base: DataFrame, movement: DataFrame, score: str) -> DataFrame:
    """Parts of the next movement matched to the base's in order: the leftmost compatible part after the last match.

    Both have (score, part_ord, name, n_staves). Rows (score, part_ord, base_ord), base_ord null for a new part. The
    candidate pairs are tested by expressions; only their greedy choice runs in Python, a score at a time.
    """
    kind = dict(base.dtypes)[score]
    b = base.select(score, F.col("part_ord").alias("base_ord"), F.col("name").alias("__bn"), F.col("n_staves").alias("__bs"))
    pairs = movement.join(b, score, "left").withColumn("fits", F.coalesce((F.col("n_staves") == F.col("__bs")) & ((F.lower(F.trim("name")) == F.lower(F.trim("__bn"))) | names_compatible(F.col("name"), F.col("__bn"))), F.lit(False)))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        last, rows = -1, []
        for part, p in pdf.sort_values(["part_ord", "base_ord"]).groupby("part_ord"):
            fit = [int(x) for x, ok in zip(p["base_ord"], p["fits"]) if ok and x > last]
            rows.append((pdf[score].iat[0], part, fit[0] if fit else None))
            last = fit[0] if fit else last
        return pd.DataFrame(rows, columns=[score, "part_ord", "base_ord"]).astype({"base_ord": "Int64"})

    return pairs.groupBy(score).applyInPandas(choose, f"{score} {kind}, part_ord int, base_ord int")


def never_together(presence: DataFrame, score: str, part: str, place: str) -> DataFrame:
    """Pairs of parts of a score (few) that are never present at the same place."""
    parts = presence.select(score, part).distinct()
    a = parts.select(score, F.col(part).alias("part_a"))
    b = parts.select(score, F.col(part).alias("part_b"))
    x = presence.select(score, F.col(part).alias("part_a"), place).distinct()
    y = presence.select(score, F.col(part).alias("part_b"), place).distinct()
    met = x.join(y, [score, place]).filter("part_a < part_b").select(score, "part_a", "part_b").distinct()
    return a.join(b, score).filter("part_a < part_b").join(met, [score, "part_a", "part_b"], "left_anti")


def differs_from_first(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs, nulls compared as values, from the first row's of the key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumn("__first", F.first(F.struct(F.col(value).alias("v"))).over(w))
    return d.filter(~F.col(value).eqNullSafe(F.col("__first.v"))).drop("__first")


def first_match(df: DataFrame, text: Column, rules: list[tuple[str, str]], name: str = "rule") -> DataFrame:
    """The name of the first rule whose pattern is found in the text; null where none is."""
    x = F.lit(None).cast("string")
    for rule, pattern in reversed(rules):
        x = F.when(text.rlike(pattern), F.lit(rule)).otherwise(x)
    return df.withColumn(name, x)


def by_ordinal(a: DataFrame, b: DataFrame, keys: list[str], ordinal: str, value: str) -> DataFrame:
    """Rows of both sides paired by their ordinal; either side null where the other has more."""
    x, y = a.select(*keys, ordinal, F.col(value).alias("a")), b.select(*keys, ordinal, F.col(value).alias("b"))
    return x.join(y, [*keys, ordinal], "full")
