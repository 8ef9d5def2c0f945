"""Samples whose category shares match targets: counts by signature repaired by swaps, then drawn at random."""

from __future__ import annotations

import random
from collections.abc import Iterable
from decimal import ROUND_CEILING, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stavework.runtime import salted_rank


def needs(targets: list[tuple[Decimal, int]], size: int) -> list[int]:
    """Rows each target asks for: its share of the sample, rounded up exactly, at least its floor."""
    return [max(int((Decimal(share) * size).to_integral_value(ROUND_CEILING)), floor) for share, floor in targets]


def swap_repair(have: list[int], meets: list[tuple[int, ...]], want: list[int], floors: list[int], size: int, seed: int) -> list[int]:
    """How many rows of each signature the sample takes: ``size`` in all (or all there are).

    Signature i has ``have[i]`` rows, each of which counts for the targets ``meets[i]``. Starts from a random draw of
    counts that holds the floors as far as rows and size allow, then swaps: signatures are exchanged for others as long
    as that lowers the summed lack of the targets below what they want or, at equal lack, their summed surplus; each
    exchange takes as many rows as it helps with. No exchange takes a target below its floor. At the end no exchange of
    one signature for another helps.
    """
    rng, n = random.Random(seed), len(have)
    size = min(size, sum(have))
    got, take = [0] * len(want), [0] * n

    def move(i: int, k: int) -> None:
        take[i] += k
        for t in meets[i]:
            got[t] += k

    # floors first, the scarcest target before the others
    room = [0] * len(want)
    for i in range(n):
        for t in meets[i]:
            room[t] += have[i]
    left = size
    for t in sorted(range(len(want)), key=lambda t: (room[t] - floors[t], t)):
        for i in sorted((i for i in range(n) if t in meets[i]), key=lambda i: (-sum(got[u] < floors[u] for u in meets[i]), i)):
            k = max(0, min(floors[t] - got[t], have[i] - take[i], left))
            move(i, k)
            left -= k
    # a random start: the rest falls on the signatures by their rows (a draw of counts, not of rows)
    free = [have[i] - take[i] for i in range(n)]
    pool = sum(free)
    for i in range(n):
        if left <= 0 or pool <= 0:
            break
        mean = left * free[i] / pool
        spread = (mean * max(0.0, 1 - free[i] / pool)) ** 0.5
        k = min(free[i], left, max(0, round(rng.gauss(mean, spread)), left - (pool - free[i])))
        move(i, k)
        left -= k
        pool -= free[i]
    # swaps
    width = max(map(len, meets), default=0)
    of = np.full((n, width), len(want))  # the last target stands for none
    for i, ts in enumerate(meets):
        of[i, : len(ts)] = ts
    of_set = [set(ts) for ts in meets]
    count, rows = np.array([*got, 0], np.int64), np.array(take, np.int64)
    most, want_, low = np.array(have, np.int64), np.array([*want, 0], np.int64), np.array([*floors, 0], np.int64)
    none = len(want)
    while n:
        # a row less or more: what the lack (times two) and the surplus of the targets change by
        less = np.where(of == none, 0, np.where(count <= want_, 2, -1)[of]).sum(axis=1) + np.where((of == none).all(axis=1), -1, 0)
        more = np.where(of == none, 0, np.where(count < want_, -2, 1)[of]).sum(axis=1) + np.where((of == none).all(axis=1), 1, 0)
        held = np.where(of == none, False, (count <= low)[of])
        found = None
        for a in np.lexsort((np.arange(n), less)):
            if rows[a] <= 0 or not of_set[a] and less[a] + more.min() >= 0:
                continue
            # targets that both meet don't change
            both = np.zeros((n, width), bool)
            for t in of_set[a]:
                both |= of == t
            change = less[a] + more - (np.where(both, np.where(count <= want_, 2, -1)[of], 0) + np.where(both, np.where(count < want_, -2, 1)[of], 0)).sum(axis=1)
            blocked = np.zeros(n, bool)
            for k, t in enumerate(of[a]):
                if held[a, k]:
                    blocked |= ~(of == t).any(axis=1)
            change = np.where((rows >= most) | blocked, 1, change)
            change[a] = 1
            b = int(change.argmin())
            if change[b] < 0:
                found = int(a), b
                break
        if found is None:
            break
        a, b = found
        # as many as keep their worth: up to the next target that is met or reaches its floor
        k = int(min(rows[a], most[b] - rows[b]))
        for t in of_set[a] - of_set[b]:
            k = min(k, int(count[t] - want_[t]) if count[t] > want_[t] else k, int(count[t] - low[t]) if count[t] > low[t] else k)
        for t in of_set[b] - of_set[a]:
            k = min(k, int(want_[t] - count[t]) if count[t] < want_[t] else k)
        k = max(1, k)
        rows[a] -= k
        rows[b] += k
        for t in of_set[a]:
            count[t] -= k
        for t in of_set[b]:
            count[t] += k
    return rows.tolist()


class Sample:
    """A matched sample: ``rows``, and ``reports`` with one table for each table of targets, one row for each target."""

    def __init__(self, df: DataFrame, key: str, targets: list[tuple[list[str], DataFrame]], size: int | None, fraction: tuple[int, int], seed: int):
        asked = [self._asked(on, table) for on, table in targets]
        # a row's signature: which target it meets in each table
        marked, marks = df, []
        for k, ((on, _), rows) in enumerate(zip(targets, asked)):
            table = df.sparkSession.createDataFrame([(i, *r[0]) for i, r in enumerate(rows)], StructType([StructField(f"__t{k}", LongType()), *(StructField(f"__{k}_{c}", df.schema[c].dataType) for c in on)]))
            marked = marked.join(F.broadcast(table), _equal([(F.col(f"`{c}`"), F.col(f"__{k}_{c}")) for c in on]), "left").drop(*[f"__{k}_{c}" for c in on])
            marks.append(f"__t{k}")
        marked = marked.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(m, F.lit(-1)).alias(m) for m in marks])
        # at most (targets + 1) to the power of the tables of targets
        counts = sorted((tuple(r[m] for m in marks), int(r["__n"])) for r in marked.groupBy(*marks).agg(F.count(F.lit(1)).alias("__n")).collect())
        total = sum(c for _, c in counts)
        self.size = size if size is not None else total * fraction[0] // fraction[1]
        first = [sum(map(len, asked[:k])) for k in range(len(asked))]
        want = needs([(share, floor) for rows in asked for _, share, floor in rows], self.size)
        meets = [tuple(first[k] + i for k, i in enumerate(sig) if i >= 0) for sig, _ in counts]
        take = swap_repair([c for _, c in counts], meets, want, [floor for rows in asked for *_, floor in rows], self.size, seed)
        self.take = {sig: n for (sig, _), n in zip(counts, take)}
        got, have = [0] * len(want), [0] * len(want)
        for m, (_, c), n in zip(meets, counts, take):
            for t in m:
                got[t] += n
                have[t] += c
        self.reports = []
        for k, ((on, _), rows) in enumerate(zip(targets, asked)):
            fields = [*(df.schema[c] for c in on), *(StructField(n, LongType()) for n in ("needed", "available", "taken"))]
            lines = [(*r[0], *(x[first[k] + i] for x in (want, have, got))) for i, r in enumerate(rows)]
            report = df.sparkSession.createDataFrame(lines, StructType([StructField(f.name, f.dataType) for f in fields]))
            self.reports.append(report.withColumn("met", F.col("taken") >= F.col("needed")))
        plan = df.sparkSession.createDataFrame([(*sig, n) for sig, n in self.take.items() if n], StructType([*(StructField(f"__p{m}", LongType()) for m in marks), StructField("__take", LongType())]))
        ranked = salted_rank(marked, marks, F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), "__rank")
        of_sig = _equal([(F.col(m), F.col(f"__p{m}")) for m in marks])
        self.rows = ranked.join(F.broadcast(plan), of_sig & (F.col("__rank") <= F.col("__take"))).select(*[F.col(f"`{c}`") for c in df.columns])

    @staticmethod
    def _asked(on: list[str], table: DataFrame) -> list[tuple[tuple, Decimal, int]]:
        # shares are written with few digits; as binary doubles their products would round up wrongly
        rows = table.select(*[F.col(f"`{c}`") for c in on], F.col("share").cast("decimal(20,10)").alias("share"), F.col("min_rows").cast("bigint").alias("min_rows")).collect()
        asked: dict[tuple, tuple[Decimal, int]] = {}
        for r in rows:  # a target given twice asks for both shares and the larger floor
            at = tuple(r[: len(on)])
            share, floor = asked.get(at, (Decimal(0), 0))
            asked[at] = share + (r["share"] or Decimal(0)), max(floor, int(r["min_rows"] or 0))
        return [(at, *x) for at, x in asked.items()]


def _equal(pairs: Iterable[tuple[Column, Column]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & a.eqNullSafe(b)
    return cond


def matched_sample(df: DataFrame, key: str, targets: list[tuple[list[str], DataFrame]], size: int | None = None, fraction: tuple[int, int] = (1, 5), seed: int = 11) -> Sample:
    """A random sample of ``df`` whose shares match all of ``targets``.

    Each entry of ``targets`` names columns of ``df`` and a table with these columns, ``share`` and ``min_rows``: on the
    category alone, the language alone, on both at once, or several such tables together. ``df`` must have one row for
    each ``key``. A row's signature tells which target of each table it meets, if any; only counts by signature (map-side
    combine) reach the driver, where ``swap_repair`` runs on them: their number depends on the targets, not on the
    values in the data. The rows are then drawn within each signature by ``salted_rank``: a signature with a third of
    all rows is no hot task. ``reports`` say of each target what it needed, what was there, what was taken, and whether
    it was met. The tables of targets are the caller's wish and go to every task. Defined results: a null in a target
    stands for rows with null there; an empty table gives an empty sample and every target with a need above 0 unmet;
    extra columns pass through. ``size`` is the number of rows, or ``fraction`` of them, rounded down.
    """
    return Sample(df, key, targets, size, fraction, seed)
