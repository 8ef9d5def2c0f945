"""Items of varying length in containers of fixed capacity, by sum-of-squares packing."""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.runtime import Shared, drop_table, materialize

#: Fixed value: the pattern at which the public byte-level vocabulary cuts a text before it joins bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Items packed together in one task; waste from unfilled containers is per block.
BLOCK = 50_000
#: Equal items that one row is turned into at most.
CHUNK = 10_000


def count_tokens(df: DataFrame, text: str, name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the exact number of tokens of the whole text; null and empty texts have none. Narrow, Arrow batches.

    ``vocabulary`` is a file of ranks on the driver; what it holds is sent to the workers once.
    """
    with open(vocabulary, "rb") as f:
        sent = Shared(df.sparkSession, f.read())

    @F.pandas_udf("bigint")
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        kept = sys.__dict__.setdefault("_stavework_encodings", {})  # one load for each worker process
        if vocabulary not in kept:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
            kept[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        enc = kept[vocabulary]
        for s in it:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return df.withColumn(name, count(F.col(f"`{text}`")))


class Packer:
    """One block. ``gaps[g]`` is the number of open containers with g units left."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.gaps = np.zeros(capacity + 1, np.int64)
        self.at: dict[int, list[int]] = {}

    def place(self, size: int) -> int:
        """The container for an item of 1..capacity units.

        Moving a container from gap h to h - size changes the sum of squared counts by 2 (N[h - size] - N[h]) + 2, by
        1 - 2 N[h] where it gets full, and a new one by 2 N[capacity - size] + 1. The smallest change wins, of equal
        ones the fullest container, a new one last.
        """
        c, n = self.capacity, self.gaps
        h = c
        if size < c:
            best = 2 * int(n[c - size]) + 1
            have = n[size:c]
            change = 2 * (n[: c - size] - have) + 2
            if have[0]:
                change[0] = 1 - 2 * have[0]
            change[have == 0] = 1 << 60
            k = int(change.argmin())
            if change[k] <= best:
                h = size + k
        if h == c:
            b = self.bins
            self.bins += 1
        else:
            b = self.at[h].pop()
            n[h] -= 1
        if h > size:
            n[h - size] += 1
            self.at.setdefault(h - size, []).append(b)
        return b


def pack(items: DataFrame, key: str, size: str, containers: dict[str, int], block: int = BLOCK, refill: float = 0.9) -> DataFrame:
    """(container_kind, container, key, piece, units) for every item and every kind of container.

    An item larger than the capacity, and only such a one, is cut: into full containers and a last piece. Items fall
    into blocks of about ``block`` by a hash of what they are (key, size and, of equal ones, their count), so every block
    sees the same mix of sizes and the result doesn't depend on how the table is stored; a block is packed in one task by
    sum of squares, the largest items first. What lies in containers filled below ``refill`` is then packed once more
    together, which is a small part of all. Blocks bound a task's memory whatever the input; no container spans blocks.
    Work is O(capacity) for each item.

    Defined results: null and negative sizes count as 0; items of size 0 share container 0 of their block; equal keys
    are separate items; an empty table gives an empty result. At most 1000 kinds.
    """
    if len(containers) > 1000 or min(containers.values(), default=1) < 1:
        raise ValueError("1 to 1000 kinds of containers, each of at least one unit")
    kind = dict(items.dtypes)[key]
    base = items.select(F.col(f"`{key}`").alias("key"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    # equal items are told apart by a number, dealt out from their count: in chunks, so that no task makes a hot key's all
    equal = base.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))
    few = equal.filter(F.col("n") <= CHUNK).withColumn("from", F.lit(0).cast("bigint"))
    many = equal.filter(F.col("n") > CHUNK).withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {CHUNK}L)")))
    many = many.repartition("key", "from")
    numbered = few.unionByName(many).withColumn("no", F.explode(F.expr(f"sequence(`from`, least(n, `from` + {CHUNK}) - 1)")))
    base = materialize(numbered.select("no", "key", "size"), "pack-items")
    rows = base.count()
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in containers.items()])
    if not containers:
        kinds = F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    each = base.select("no", "key", "size", F.explode(kinds).alias("c")).select("no", "key", "size", "c.*")
    n_blocks = max(1, -(-rows // block))
    each = each.withColumn("block", F.pmod(F.xxhash64("key", "size", "no"), F.lit(n_blocks)))
    # full pieces of oversize items need no packing
    whole = each.filter("size > capacity").select("container_kind", "no", "key", "size", "capacity", F.explode(F.expr("sequence(0L, (size - 1) div capacity - 1)")).alias("piece"))
    left = each.select("container_kind", "capacity", "block", "key", "no", F.when(F.col("size") > F.col("capacity"), F.expr("(size - 1) div capacity")).otherwise(F.lit(0)).alias("piece"), F.when(F.col("size") > F.col("capacity"), F.expr("(size - 1) % capacity + 1")).otherwise(F.col("size")).alias("units"))
    schema = f"container_kind string, capacity bigint, block bigint, bin bigint, fill bigint, key {kind}, no bigint, piece bigint, units bigint"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iat[0])
        pdf = pdf.sort_values(["units", "key", "piece", "no"], ascending=[False, True, True, True], kind="stable")
        p = Packer(capacity)
        units = pdf["units"].to_numpy()
        bins = np.fromiter((p.place(int(u)) if u else 0 for u in units), np.int64, len(units))
        fill = np.zeros(max(1, p.bins), np.int64)
        np.add.at(fill, bins, units)
        return pdf.assign(bin=bins, fill=fill[bins])[["container_kind", "capacity", "block", "bin", "fill", "key", "no", "piece", "units"]]

    first = materialize(left.groupBy("container_kind", "block").applyInPandas(one, schema), "pack-first")
    good = F.col("fill") >= F.lit(refill) * F.col("capacity")
    loose = first.filter(~good)
    n_loose = max(1, -(-loose.count() // (block * max(1, len(containers)))))
    again = loose.select("container_kind", "capacity", F.pmod(F.xxhash64("key", "piece", "no", "bin"), F.lit(n_loose)).alias("block"), "key", "no", "piece", "units")
    second = again.groupBy("container_kind", "block").applyInPandas(one, schema)
    name = lambda *parts: F.concat_ws("-", *parts)
    out = first.filter(good).select("container_kind", name(F.lit("a"), "block", "bin").alias("container"), "key", "piece", "units")
    out = out.unionByName(second.select("container_kind", name(F.lit("b"), "block", "bin").alias("container"), "key", "piece", "units"))
    full = whole.select("container_kind", name(F.lit("full"), F.coalesce(F.col("key").cast("string"), F.lit("")), "size", "no", "piece").alias("container"), "key", "piece", F.col("capacity").alias("units"))
    return out.unionByName(full).withColumnRenamed("key", key)
