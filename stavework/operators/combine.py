"""Parts of several readings combined to one score: least-cost alignment of measures, filling, checks on it."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the cost of setting two measures side by side.
ONE_SILENT, LANDMARK, CHANGE, NEAR_BEST, MOST_FILLED = 0.6, 0.5, 0.25, 0.1, 0.25


def cost(a: tuple, b: tuple) -> float:
    """Rhythm and marks of two measures ``(index, onsets, silent, landmark, key, time)``.

    Rhythm: 0 both silent, ONE_SILENT one, else 1 less the shared onsets over all. Marks: LANDMARK if exactly one ends
    in one, CHANGE for a key and for a time only one states, unless either is the first measure.
    """
    (ia, oa, sa, la, ka, ta), (ib, ob, sb, lb, kb, tb) = a, b
    rhythm = 0.0 if sa and sb else ONE_SILENT if sa or sb else 1.0 - len(oa & ob) / max(1, len(oa | ob))
    marks = LANDMARK * (la != lb) + (CHANGE * (ka != kb) + CHANGE * (ta != tb) if ia and ib else 0.0)
    return rhythm + marks


def place(longer: list[tuple], shorter: list[tuple]) -> tuple[list[int], list[tuple[int, int]]]:
    """Where each measure of the shorter part goes, at least total cost, and the spans in which gaps are uncertain.

    Only the shorter has gaps; of equal totals the one whose gaps come latest. A gap's span are the places it could take
    at a total within NEAR_BEST of the least.
    """
    n, m = len(longer), len(shorter)
    free = n - m
    c = [[cost(longer[j + g], shorter[j]) for g in range(free + 1)] for j in range(m)]

    @lru_cache(maxsize=None)
    def rest(j: int, g: int) -> float:  # least cost of shorter[j:] with g gaps used
        if j == m:
            return 0.0
        return min(c[j][g] + rest(j + 1, g), rest(j, g + 1) if g < free else float("inf"))

    for j in range(m, -1, -1):  # filled backwards, so that no call goes deep
        for g in range(free, -1, -1):
            rest(j, g)
    at, g = [], 0
    for j in range(m):
        while g < free and c[j][g] + rest(j + 1, g) > rest(j, g + 1) + 1e-12:
            g += 1
        at.append(j + g)
    best = rest(0, 0)
    before = [[float("inf")] * (free + 1) for _ in range(m + 1)]
    before[0] = [0.0] * (free + 1)
    for j in range(m):
        low = float("inf")
        for h in range(free + 1):
            low = min(low, before[j][h])
            before[j + 1][h] = low + c[j][h]
    spans = []
    taken = set(at)
    for gap in (k for k in range(n) if k not in taken):
        number = sum(1 for k in range(gap) if k not in taken)
        # the gap number ``number`` can lie before shorter[j] if going on with one gap more is nearly as good
        ok = [j + number for j in range(m + 1) if min(before[j][: number + 1]) + (rest(j, number + 1) if number < free else float("inf")) <= best + NEAR_BEST]
        spans.append((min([gap, *ok]), max([gap, *ok])))
    return at, spans


def align_parts(parts: DataFrame, score: str = "score_id") -> DataFrame:
    """J12, card C: for each part of a score the grid column of its measures, with gaps to fill.

    ``parts(score, part_ord, is_reference, measures array<struct<m_idx,onsets,silent,landmark,has_key,has_time>>)``. Rows
    (score, part_ord, column, m_idx, uncertain): ``m_idx`` is null where a rest is filled in, ``uncertain`` how many columns
    the measure could lie in. Parts of one length need no search. The grid grows by folding parts into the reference.
    """
    kind = dict(parts.dtypes)[score]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["is_reference", "part_ord"], ascending=[False, True])
        read = {int(p): [(int(x["m_idx"]), frozenset(x["onsets"]), bool(x["silent"]), bool(x["landmark"]), bool(x["has_key"]), bool(x["has_time"])) for x in ms] for p, ms in zip(pdf["part_ord"], pdf["measures"])}
        grid: list[tuple] = []
        cols: dict[int, dict[int, int]] = {}
        unsure: dict[int, dict[int, int]] = {}
        for p, ms in read.items():
            if not grid:
                grid, cols[p] = list(ms), {k: x[0] for k, x in enumerate(ms)}
            elif len(ms) == len(grid):
                cols[p] = {k: x[0] for k, x in enumerate(ms)}
            elif len(ms) < len(grid):
                at, spans = place(grid, ms)
                cols[p] = {k: x[0] for k, x in zip(at, ms)}
                unsure[p] = {k: b - a + 1 for a, b in spans for k in range(a, b + 1) if b > a}
            else:  # the part is longer: the grid gets its columns
                at, _ = place(ms, grid)
                cols = {q: {at[k]: v for k, v in old.items()} for q, old in cols.items()}
                unsure = {q: {at[k]: v for k, v in old.items()} for q, old in unsure.items()}
                cols[p] = {k: x[0] for k, x in enumerate(ms)}
                grid = list(ms)
        rows = [(pdf[score].iat[0], p, k, cols[p].get(k), unsure.get(p, {}).get(k, 1)) for p in read for k in range(len(grid))]
        return pd.DataFrame(rows, columns=[score, "part_ord", "column", "m_idx", "uncertain"]).astype({"m_idx": "Int64"})

    return parts.groupBy(score).applyInPandas(one, f"{score} {kind}, part_ord int, column int, m_idx int, uncertain int")


def rejected(aligned: DataFrame, score: str = "score_id") -> DataFrame:
    """Parts of which more than MOST_FILLED had to be filled in."""
    share = aligned.groupBy(score, "part_ord").agg(F.avg(F.col("m_idx").isNull().cast("double")).alias("filled"))
    return share.filter(F.col("filled") > MOST_FILLED)


def lowered(events: DataFrame, aligned: DataFrame, score: str = "score_id") -> DataFrame:
    """Events with the confidence that their measure's place allows: at most one over its possible columns; 0 is kept."""
    a = aligned.filter("m_idx IS NOT NULL").select(score, "part_ord", "m_idx", "uncertain")
    d = events.join(a, [score, "part_ord", "m_idx"], "left")
    return d.withColumn("confidence", F.when(F.col("uncertain") > 1, F.least(F.coalesce("confidence", F.lit(1.0)), 1.0 / F.col("uncertain"))).otherwise(F.col("confidence"))).drop("uncertain")


def selected_parts(wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """The parts asked for by (job, part); an error names one that isn't there."""
    d = wanted.join(parts.withColumn("__there", F.lit(True)), ["job", "part"], "left")
    return d.withColumn("part", F.when(F.col("__there"), F.col("part")).otherwise(F.raise_error(F.concat(F.lit("no such part: "), F.col("part"))))).drop("__there")
