"""Splits that keep related records together: connected components in joined tables, then subset sums over sizes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.runtime import drop_table, materialize, salted_rank


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` with an edge to another; ``root`` is the smallest of its component.

    Parallel hooking and shortcutting over a parent table. A round hooks every node to its smallest neighbour (a hash
    aggregate with map-side combine, so a node with a third of all edges is no hot task), then shortcuts
    ``parent = parent[parent]``, two self joins between writes, until the last changes nothing, then contracts the edges
    to roots and drops loops and copies. Each round at least halves the nodes of every component not yet done, so rounds
    end by themselves; tables are written to the shared folder after each step, so lost executors cost no earlier
    round. Only counts reach the driver. Null ends and loops give no rows; an empty table gives an empty result.
    """
    e = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    of: DataFrame | None = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent"))
        parent = materialize(hooked, "parent")
        while True:
            jumped = materialize(_shortcut(_shortcut(parent).drop("moved"), parent), "parent")
            drop_table(parent)
            parent = jumped
            if parent.filter("moved").isEmpty():
                break
        p1 = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        p2 = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = e.join(p1, "a").join(p2, "b").filter("pa <> pb")
        left = materialize(left.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "edges")
        drop_table(e)
        e = left
        if of is None:
            of = parent
        else:
            up = parent.select(F.col("node").alias("at"), F.col("parent").alias("above"))
            new = materialize(of.join(up, F.col("parent") == F.col("at"), "left").select("node", F.coalesce("above", "parent").alias("parent")), "roots")
            drop_table(of)
            drop_table(parent)
            of = new
    if of is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return of.select("node", F.col("parent").alias("root"))


def _shortcut(nodes: DataFrame, parent: DataFrame | None = None) -> DataFrame:
    """``nodes(node, parent)`` with each parent replaced by its own parent; ``moved`` where that is another."""
    up = (nodes if parent is None else parent).select(F.col("node").alias("at"), F.col("parent").alias("above"))
    jumped = nodes.join(up, F.col("parent") == F.col("at"), "left")
    return jumped.select("node", F.coalesce("above", "parent").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))


def star_edges(members: DataFrame, node: str, group: str) -> DataFrame:
    """Edges (a, b) that tie all nodes of a group to its smallest: as many edges as members, no pairs."""
    m = members.select(F.col(node).alias("a"), F.col(group).alias("g")).filter("a IS NOT NULL AND g IS NOT NULL")
    least = m.groupBy("g").agg(F.min("a").alias("b"))
    return m.join(least, "g").filter("a <> b").select("a", "b")


def choose_counts(sizes: dict[int, int], targets: dict[str, int]) -> dict[str, dict[int, int]]:
    """How many components of each size go to each split, for totals as near to ``targets`` as can be.

    ``sizes`` maps a component size to how many components have it. The splits are filled from the smallest target on
    (``nearest_total``); the largest target takes the rest.
    """
    left = {s: k for s, k in sizes.items() if k > 0}
    out: dict[str, dict[int, int]] = {}
    names = sorted(targets, key=lambda s: (targets[s], s))
    for name in names[:-1]:
        out[name] = nearest_total(left, targets[name])
        for s, k in out[name].items():
            left[s] -= k
            if not left[s]:
                del left[s]
    out[names[-1]] = left
    return out


def nearest_total(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many components of each size make the total nearest to ``target``.

    First every size gives its part of the target: from the largest on, as many components as bring the total so far
    nearest to the target's share of the records so far. So a split gets its share of the large components too, at any
    number of records. What is missing or too much then is found by subset sums over the multiplicities: a
    set of bits says which changes can be reached by adding and taking away components of the sizes seen so far, the
    smallest first; a multiplicity enters as chunks of 1, 2, 4, ... copies, each one shifted or. For each change the
    chunk that first reached it is kept, from which the choice is traced back. A change that hits the target ends the
    search, mostly after the few smallest sizes, with bits for a few times the largest size looked at. Where none within
    this span hits it, all changes are looked at: the result is always a nearest total. That last step takes 10 bytes
    for each record (over the sizes' common divisor); it is for totals that can't be hit, as of few components.
    """
    if not sizes:
        return {}
    unit = math.gcd(*sizes)
    have, aim = {s // unit: k for s, k in sizes.items()}, target / unit
    total, got, sofar, base = sum(s * k for s, k in have.items()), 0, 0, {}
    for s in sorted(have, reverse=True):
        sofar += s * have[s]
        base[s] = min(have[s], max(0, round((sofar * aim / total - got) / s)))
        got += s * base[s]
    missing = round(aim) - got
    change = _changes(have, base, missing, None)
    if change is None:
        change = _changes(have, base, missing, aim - got)
    return {s * unit: base[s] + change.get(s, 0) for s in have if base[s] + change.get(s, 0)}


def _changes(have: dict[int, int], base: dict[int, int], missing: int, best: float | None) -> dict[int, int] | None:
    """Components to add (or take away, below 0) by size; within a span for the exact change, or over all for the nearest to ``best``."""
    if missing == 0 and best is None:
        return {}
    total = sum(s * k for s, k in have.items())
    width = 0 if best is None else total
    reach, first, chunks = np.ones(1, bool), np.full(1, -1, np.int32), []
    for s in sorted(have):
        more = max(2 * (abs(missing) + 2 * s), 0) if best is None else total
        if more > width or len(reach) != 2 * width + 1:  # a wider span around no change
            new = max(more, width)
            pad = new - len(reach) // 2
            reach, first = np.pad(reach, pad), np.pad(first, pad, constant_values=-1)
            width = new
        for sign, m in ((1, have[s] - base[s]), (-1, base[s])):
            m, k = min(m, 2 * width // s), 1
            while m > 0:
                k = min(k, m)
                by = s * k
                if by < len(reach):
                    hit = reach[:-by] & ~reach[by:] if sign > 0 else reach[by:] & ~reach[:-by]
                    at = np.flatnonzero(hit) + (by if sign > 0 else 0)
                    reach[at] = True
                    first[at] = len(chunks)
                    chunks.append((s, sign * k))
                m -= k
                k *= 2
        if best is None and reach[width + missing]:
            break
    else:
        if best is None:
            return None
    at = width + missing
    if best is not None:
        can = np.flatnonzero(reach)
        at = int(can[np.argmin(np.abs(can - width - best))])
    out: dict[int, int] = {}
    while first[at] >= 0:
        s, k = chunks[first[at]]
        out[s] = out.get(s, 0) + k
        at -= s * k
    return out


def assign_splits(components: DataFrame, shares: dict[str, float], seed: int = 17) -> DataFrame:
    """(root, n, split) from ``components(root, n)`` so that the sums of ``n`` come nearest to the shares.

    Only the sizes with their multiplicities reach the driver: for a total of T records fewer than sqrt(2 T)
    distinct sizes. Which components of a size go where is drawn by a hash of the root and ``seed``.
    """
    sizes = {int(r["n"]): int(r["k"]) for r in components.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    total = sum(s * k for s, k in sizes.items())
    whole = sum(shares.values()) or 1.0
    counts = choose_counts(sizes, {name: round(total * share / whole) for name, share in shares.items()}) if sizes else {}
    spark = components.sparkSession
    bounds, upto = [], dict.fromkeys(sizes, 0)
    for name, taken in counts.items():
        for s, k in taken.items():
            bounds.append((s, upto[s], upto[s] + k, name))
            upto[s] += k
    table = spark.createDataFrame(bounds, "size bigint, above bigint, upto bigint, split string")
    ranked = salted_rank(components, ["n"], F.xxhash64("root", F.lit(seed)), "r")
    return ranked.join(table, (F.col("n") == F.col("size")) & (F.col("r") > F.col("above")) & (F.col("r") <= F.col("upto"))).select("root", "n", "split")
