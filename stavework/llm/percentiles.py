"""Percentiles with a stated error by deterministic buffer collapsing; summaries merge in any order."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.runtime import drop_table, materialize

#: Values of a buffer. The rank error of n values is at most about log2(n / K) / (2 K) of n.
K = 2048

#: ``buffers`` holds the loose values and then the full buffers one after the other, ``weights`` one weight for each of these.
SUMMARY = "n bigint, err bigint, weights array<bigint>, buffers array<double>"
#: Summaries that one step of the tree merges to one.
FAN = 16


class Summary:
    """Sorted buffers of ``k`` values, each of a weight 2^level, one loose buffer of weight 1, and the rank error so far.

    Two full buffers of one weight w collapse to one of weight 2 w: of their 2 k merged values every second stays, the
    odd ones and the even ones in turn. A value's rank in the merged buffer moves by at most w, so the error of the
    whole is at most the sum of w over all collapses; ``err`` holds this sum and is a proven bound, no estimate.
    """

    def __init__(self, k: int = K):
        self.k, self.n, self.err, self.turn = k, 0, 0, 0
        self.full: dict[int, list[np.ndarray]] = defaultdict(list)
        self.loose = np.empty(0)

    def add(self, values: np.ndarray) -> None:
        """Takes values of weight 1."""
        self.n += len(values)
        self._loosen(values)
        self._collapse()

    def _loosen(self, values: np.ndarray) -> None:
        pool = np.sort(np.concatenate((self.loose, values)), kind="stable")
        m = len(pool) // self.k
        # full buffers of neighbours in the stream's order would do; strided ones represent the whole pool
        rest = len(pool) - m * self.k
        if m:
            at = np.arange(len(pool))
            loose = np.zeros(len(pool), bool)
            if rest:
                loose[np.floor((np.arange(rest) + 0.5) * len(pool) / rest).astype(int)] = True
            kept = pool[at[~loose]]
            for j in range(m):
                self.full[0].append(kept[j::m])
            pool = pool[loose]
        self.loose = pool

    def _collapse(self) -> None:
        level = 0
        while level <= max(self.full, default=-1):
            bufs = self.full[level]
            while len(bufs) >= 2:
                both = np.sort(np.concatenate((bufs.pop(), bufs.pop())), kind="stable")
                self.full[level + 1].append(both[self.turn :: 2])
                self.turn ^= 1
                self.err += 1 << level
            level += 1

    def merge(self, other: Summary) -> None:
        self.n += other.n
        self.err += other.err
        for level, bufs in other.full.items():
            self.full[level].extend(bufs)
        self._loosen(other.loose)
        self._collapse()

    def quantiles(self, qs: list[float]) -> list[float]:
        """For each q the value at rank ceil(q n) of the weighted buffers (the smallest for q = 0)."""
        values = [self.loose, *(b for bufs in self.full.values() for b in bufs)]
        weights = [np.ones(len(self.loose), np.int64), *(np.full(len(b), 1 << level, np.int64) for level, bufs in self.full.items() for b in bufs)]
        v, w = np.concatenate(values), np.concatenate(weights)
        if not len(v):
            return [float("nan")] * len(qs)
        order = np.argsort(v, kind="stable")
        upto = np.cumsum(w[order])
        return [float(v[order][min(np.searchsorted(upto, max(1, int(np.ceil(q * self.n)))), len(v) - 1)]) for q in qs]

    def row(self) -> tuple[int, int, list[int], np.ndarray]:
        bufs = [(1 << level, b) for level in sorted(self.full) for b in self.full[level]]
        return self.n, self.err, [w for w, _ in bufs], np.concatenate([self.loose, *(b for _, b in bufs)])

    @staticmethod
    def of(n: int, err: int, weights: np.ndarray, buffers: np.ndarray, k: int = K) -> Summary:
        s = Summary(k)
        s.n, s.err = int(n), int(err)
        first = len(buffers) - k * len(weights)
        s.loose = buffers[:first]
        for i, w in enumerate(weights):
            s.full[int(w).bit_length() - 1].append(buffers[first + i * k : first + (i + 1) * k])
        return s


def _arrow(keys: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    m = len(types)
    arrays = [pa.array(c, t) for c, t in zip(cols, types)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in cols[m + 3]])))
    buffers = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(cols[m + 3])))
    arrays += [pa.array(cols[m], pa.int64()), pa.array(cols[m + 1], pa.int64()), pa.array(cols[m + 2], pa.list_(pa.int64())), buffers]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "n", "err", "weights", "buffers"])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as views of its values."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    at = at - at[0]
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def summarise(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """(keys..., n, err, weights, buffers): one summary for each key, from which ``percentiles`` reads or ``combine`` merges.

    Every task first summarises its own rows of each key, so that a key with a third of all rows sends bounded buffers
    instead of values; these are merged in a tree (``combine``). Null and NaN are no values; a key without any value gives no row.
    Null keys are keys. Infinities are values. Extra columns are ignored.
    """
    names = [f"k{i}" for i in range(len(keys))]
    x = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, names)], F.col(f"`{value}`").cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    kinds = [f.dataType.simpleString() for f in x.schema.fields[:-1]]
    ddl = ", ".join(f"{a} {t}" for a, t in zip(names, kinds))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple, Summary] = {}
        waiting: dict[tuple, list[np.ndarray]] = defaultdict(list)
        held, types = 0, None
        for b in batches:
            types = [f.type for f in b.schema][:-1]
            values = b.column(len(names)).to_numpy(zero_copy_only=False)
            codes = np.zeros(len(values), np.int64)
            tables = []
            for i in range(len(names)):
                d = b.column(i).dictionary_encode()
                tables.append([*d.dictionary.to_pylist(), None])
                c = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                codes = codes * (len(d.dictionary) + 1) + c
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for part in np.split(order, cuts):
                if not len(part):
                    continue
                key, c = [], int(codes[part[0]])
                for t in reversed(tables):
                    key.append(t[c % len(t)])
                    c //= len(t)
                waiting[tuple(reversed(key))].append(values[part])
            held += len(values)
            if held >= 1 << 20:  # bounds what a task holds
                for key, parts in waiting.items():
                    own.setdefault(key, Summary(k)).add(np.concatenate(parts))
                waiting.clear()
                held = 0
                if sum(1 for _ in own) > 20_000:  # many keys: pass them on
                    yield from _chunks(names, types, own)
                    own.clear()
        for key, parts in waiting.items():
            own.setdefault(key, Summary(k)).add(np.concatenate(parts))
        if own:
            yield from _chunks(names, types, own)

    return _rename(_merged(x.mapInArrow(local, f"{ddl}, {SUMMARY}" if ddl else SUMMARY), names, ddl, k), names, keys)


def _batch_rows(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows in runs of bounded size, as one key's buffers can be a hundred times another's."""
    start, size = 0, 0
    for i, r in enumerate(rows):
        size += len(r[-1])
        if size >= 1 << 20:
            yield rows[start : i + 1]
            start, size = i + 1, 0
    if start < len(rows):
        yield rows[start:]


def _chunks(names: list[str], types: list[pa.DataType], own: dict[tuple, Summary]) -> Iterator[pa.RecordBatch]:
    rows = [(*key, *s.row()) for key, s in own.items()]
    for some in _batch_rows(rows):
        yield _arrow(names, types, some)


def _rename(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    return df.select(*[F.col(a).alias(c) for a, c in zip(names, keys)], "n", "err", "weights", "buffers")


def _merged(parts: DataFrame, names: list[str], ddl: str, k: int) -> DataFrame:
    """Merges summaries of equal keys in a tree until each key has one.

    ``parts`` is written to the shared folder, so that the number of summaries of the most frequent key can be counted (one
    number reaches the driver); it says how many steps the tree needs. A step spreads the summaries of each key, small
    or full, over as many random shares as leave about FAN to each, and merges each share as it streams by in key order:
    a task holds one summary at a time, and no task gets more of a hot key than its shares.
    """
    schema = f"{ddl}, {SUMMARY}" if ddl else SUMMARY
    held = materialize(parts.withColumn("no", F.monotonically_increasing_id()), "summaries")
    most = held.groupBy(*names).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    step = held
    while most > FAN:
        shares = -(-most // FAN)
        salted = step.withColumn("share", F.pmod(F.xxhash64("no"), F.lit(shares)).cast("int"))
        by_share = salted.repartition(*names, "share").sortWithinPartitions(*names, "share", F.desc("n"), "no").select(*names, "share", "n", "err", "weights", "buffers")
        # written, so that a step run again after a loss deals out the same numbers
        step, before = materialize(by_share.mapInArrow(_runs(names, 1, k), schema).withColumn("no", F.monotonically_increasing_id()), "summaries"), step
        drop_table(before)
        most = shares
    whole = step.repartition(*names) if names else step.repartition(1)
    whole = whole.sortWithinPartitions(*names, F.desc("n"), "no").select(*names, "n", "err", "weights", "buffers")
    return whole.mapInArrow(_runs(names, 0, k), schema)


def _runs(names: list[str], more: int, k: int):
    """Merges runs of rows with equal keys; ``more`` columns after the keys also tell runs apart and are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, now, held, s, types, done, size = len(names), None, None, None, None, [], 0

        def close() -> None:
            nonlocal size
            done.append((*now[:m], *(s.row() if s is not None else held)))
            size += len(done[-1][-1])

        for b in batches:
            types = [f.type for f in b.schema][:m]
            cols = [c.to_pylist() for c in b.columns[: m + more + 2]]
            for row in zip(*cols, _lists(b.column(m + more + 2)), _lists(b.column(m + more + 3))):
                key, own = row[: m + more], row[m + more :]
                if now is not None and key == now:
                    if s is None:
                        s = Summary.of(*held, k)
                    s.merge(Summary.of(*own, k))
                    continue
                if now is not None:
                    close()
                now, held, s = key, own, None  # most keys have one summary, which passes as it is
            if size >= 1 << 20 or len(done) >= 10_000:
                yield _arrow(names, types, done)
                done, size = [], 0
        if now is not None:
            close()
            yield _arrow(names, types, done)

    return run


def combine(summaries: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Merges summaries (of days, partitions, earlier runs) to one for each of ``keys``, a part of their key columns, in a tree."""
    names = [f"k{i}" for i in range(len(keys))]
    x = summaries.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, names)], "n", "err", "weights", "buffers")
    ddl = ", ".join(f"{a} {f.dataType.simpleString()}" for a, f in zip(names, x.schema.fields))
    return _rename(_merged(x, names, ddl, k), names, keys)


def percentiles(summaries: DataFrame, qs: dict[str, float], k: int = K) -> DataFrame:
    """The key columns, ``n_values``, one column for each named q, and ``rank_error``.

    ``rank_error`` is the proven bound as a share of n: the value given for q is exact for some rank within
    ``rank_error * n`` of ceil(q n). It is 0 where nothing was collapsed: such percentiles are exact.
    """
    keys = [c for c in summaries.columns if c not in ("n", "err", "weights", "buffers")]
    fields = ", ".join(f"`{name}` double" for name in qs)

    @F.pandas_udf(f"{fields}, rank_error double")
    def read(n: pd.Series, err: pd.Series, w: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [Summary.of(x, e, ws, np.asarray(bs, float), k).quantiles(list(qs.values())) for x, e, ws, bs in zip(n, err, w, b)]
        out = pd.DataFrame(rows, columns=list(qs), dtype=float)
        out["rank_error"] = (err / n).to_numpy(float)
        return out

    return summaries.select(*[F.col(f"`{c}`") for c in keys], F.col("n").alias("n_values"), read("n", "err", "weights", "buffers").alias("q")).select(*[F.col(f"`{c}`") for c in keys], "n_values", "q.*")
