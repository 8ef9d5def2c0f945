"""Held-out items that documents repeat: a BM25 inverted index with block-max WAND finds candidates, words are compared then."""

from __future__ import annotations

import html
import math
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.runtime import Shared, drop_table, materialize

#: Consecutive words that make a repeat, and the share of all words in order within a stretch of STRETCH lengths.
RUN, SHARE, STRETCH = 20, 0.7, 2
#: Items of one index (about 3 KB each, of 120 words), and of a block that shares upper bounds.
ITEMS, ITEM_BLOCK = 16_384, 8
K1, B = 1.2, 0.75

#: A word: letters and digits, cut where a capital follows a small letter or starts a capitalised part. So each is
#: all small, all capital, or small after its first letter.
_WORD = re.compile(r"[A-Z]+[0-9]*(?![^\W\d_A-Z])|[A-Z]?[^\W_A-Z]+")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[abfnrtv0\"'`/\\]|\n)")
_NUMBERED = re.compile(r"^([^\w\n]*)(\d+)(?=[:.|)\]>\t]|[ \t]{1,4}\S|$)", re.M)


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else "\n"


def undo_layout(text: str) -> str:
    """The text without what a file adds to lay words out or to write them in its own notation.

    Character references, string escapes and percent escapes are undone. Joined words (``paleGate``) are cut by the
    word pattern; comment marks, quotes, markup and case don't touch words. Line numbers: ``drop_numbers``.
    """
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if text.count("%20") > 2:
        text = unquote(text)
    return text


def drop_numbers(text: str) -> str:
    """Without numbers at the start of lines that count up by one from line to line."""
    found = [(m.start(2), m.end(2), int(m[2][:15])) for m in _NUMBERED.finditer(text)]
    cut = []
    for k, (a, b, n) in enumerate(found):
        before = k > 0 and found[k - 1][2] == n - 1 and text.count("\n", found[k - 1][0], a) == 1
        after = k + 1 < len(found) and found[k + 1][2] == n + 1 and text.count("\n", a, found[k + 1][0]) == 1
        if before or after:
            cut.append((a, b))
    if len(cut) < 3:
        return text
    out, at = [], 0
    for a, b in cut:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case, of the text without layout."""
    return [w.lower() for w in _WORD.findall(undo_layout(text))] if text else []


class ItemIndex:
    """An inverted index of items: postings by term in blocks of items, and the scores that no repeat falls below.

    A posting is (item, impact, count): ``impact`` is what one occurrence of the term adds to the item's BM25 score, up to
    ``count`` occurrences, as often as the item has it. Blocks of ITEM_BLOCK neighbouring items have their largest
    impact and count beside, and each term its largest of all. Memory follows the number of postings.

    Both rules bound the score from below. A run of RUN words lies whole in a short passage, which scores at least what
    the least valuable run of the item is worth. A stretch lies whole in a long passage, which scores at least the
    least valuable SHARE of the item's words. Impacts aren't negative, and no rule counts a word more often than the
    item has it. So retrieval above the threshold of each rule loses no repeat.
    """

    def __init__(self, items: list[tuple[int, list[str]]]):
        items = [(i, w) for i, w in items if w]
        n = len(items)
        self.ids = np.array([i for i, _ in items], np.int64)
        term: dict[str, int] = {}
        self.words = np.array([term.setdefault(t, len(term)) for _, w in items for t in w], np.int32)
        self.at = np.concatenate(([0], np.cumsum([len(w) for _, w in items], dtype=np.int64)))
        size = np.diff(self.at)
        item = np.repeat(np.arange(n), size)
        # postings in the order (term, item)
        key, count = np.unique(self.words.astype(np.int64) * max(1, n) + item, return_counts=True)
        t, j = np.divmod(key, max(1, n))
        df = np.bincount(t, minlength=len(term))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        length = K1 * (1 - B + B * size / max(1.0, size.mean() if n else 1.0))
        self.post_key, self.post_count = key, count.astype(np.int32)
        self.post_impact = (idf[t] * count * (K1 + 1) / (count + length[j]) / count).astype(np.float32)
        # blocks of postings, each with its maxima; the same for a term's whole list
        self.n_blocks = -(-n // ITEM_BLOCK)
        block = t * max(1, self.n_blocks) + j // ITEM_BLOCK
        first = np.flatnonzero(np.diff(block, prepend=-1))
        self.block_key = block[first]
        self.block_impact, self.block_count = _top(self.post_impact, first), _top(self.post_count, first)
        lists = np.flatnonzero(np.diff(t, prepend=-1))
        self.best_impact, self.best_count = _top(self.post_impact, lists), _top(self.post_count, lists)
        self.list_end = np.searchsorted(self.block_key, (np.arange(len(term)) + 1) * max(1, self.n_blocks))
        self.written = {x: k for w, k in term.items() for x in (w.upper(), w.capitalize(), w)}  # a word's three ways of writing
        # thresholds
        own = self.post_impact[np.searchsorted(key, self.words.astype(np.int64) * max(1, n) + item)].astype(np.float64)
        self.need = np.ceil(SHARE * size - 1e-9).astype(np.int64)
        run, share = np.full(n, math.inf), np.zeros(n)
        for k in range(n):
            x = own[self.at[k] : self.at[k + 1]]
            share[k] = np.sort(x)[: self.need[k]].sum()
            if len(x) >= RUN:
                upto = np.concatenate(([0.0], np.cumsum(x)))
                run[k] = (upto[RUN:] - upto[:-RUN]).min()
        longest = int(size.max()) if n else 1
        # (words between the starts of passages twice as long, score and words that a repeat of each item shares at least)
        self.rules = ((RUN, run * (1 - 1e-4), np.full(n, RUN)), (STRETCH * longest, share * (1 - 1e-4), self.need))
        # a hash for each run of RUN words within an item
        h = _hashes(self.words)
        inside = np.flatnonzero(np.arange(len(h)) + RUN <= np.repeat(self.at[1:], size)[: len(h)]) if len(h) else np.zeros(0, np.int64)
        order = np.argsort(h[inside], kind="stable")
        self.run_hash, self.run_at = h[inside][order], inside[order].astype(np.int32)

    def seq(self, j: int) -> np.ndarray:
        return self.words[self.at[j] : self.at[j + 1]]

    def runs(self, seq: np.ndarray) -> set[int]:
        """Items of which ``seq`` holds RUN consecutive words."""
        h = _hashes(seq)
        lo, hi = np.searchsorted(self.run_hash, h), np.searchsorted(self.run_hash, h, "right")
        at, k = _spread(lo, hi)
        own, within = self.run_at[at], np.arange(RUN)
        same = (seq[k[:, None] + within] == self.words[own[:, None] + within]).all(axis=1)
        return set((np.searchsorted(self.at, own[same], "right") - 1).tolist())


def _top(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest of each run that begins at ``first``."""
    return np.maximum.reduceat(x, first) if len(x) else x


def _hashes(seq: np.ndarray) -> np.ndarray:
    """A hash for each run of RUN term numbers."""
    if len(seq) < RUN:
        return np.zeros(0, np.uint64)
    x = (seq.astype(np.int64) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n = len(seq) - RUN + 1
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h = h * np.uint64(0x100000001B3) + x[k : k + n]
    return h


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers lo .. hi - 1 of each range, and which range each is of."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


def retrieve(ix: ItemIndex, passage: np.ndarray, term: np.ndarray, least: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages, items) of all pairs that score at least ``least`` of the item and share ``shared`` words with it, by block-max WAND.

    ``passage`` and ``term`` tell which terms occur in which passage, once for each occurrence. Every passage is a query;
    all are moved through the posting lists together. A step sorts the lists of each passage by the block under their
    cursor, adds up the largest scores of whole lists until they reach the least threshold, which gives the pivot block,
    and moves the lists before it there by a search. If the maxima of the pivot block reach the least threshold within
    it, the postings of the block are scored; in any case the cursors pass on. A passage ends when its lists can't reach
    a threshold any more.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(term) or not len(ix.ids) or not np.isfinite(least).any():
        return none
    t_all = len(ix.best_impact)
    key, count = np.unique(passage * t_all + term, return_counts=True)
    p, t = np.divmod(key, t_all)
    bound = np.minimum(count, ix.best_count[t]) * ix.best_impact[t].astype(np.float64)
    block_least = np.minimum.reduceat(least, np.arange(0, len(least), ITEM_BLOCK))
    at_least = block_least.min()
    # passages that can't share or score enough with any item are no queries
    start = np.flatnonzero(np.diff(p, prepend=-1))
    able = (np.add.reduceat(bound, start) >= at_least) & (np.add.reduceat(np.minimum(count, ix.best_count[t]), start) >= shared.min())
    able = np.repeat(able, np.diff(np.append(start, len(p))))
    key, p, t, count, bound = key[able], p[able], t[able], count[able], bound[able]
    kp, kt, kc = p, t, count
    cursor = np.searchsorted(ix.block_key, t * ix.n_blocks)
    got_p, got_b = [], []
    while len(p):
        block = np.where(cursor < ix.list_end[t], ix.block_key[np.minimum(cursor, len(ix.block_key) - 1)] - t * ix.n_blocks, ix.n_blocks)
        order = np.argsort(p * (ix.n_blocks + 1) + block, kind="stable")
        p, t, count, bound, cursor, block = (x[order] for x in (p, t, count, bound, cursor, block))
        start = np.flatnonzero(np.diff(p, prepend=-1))
        group = np.cumsum(np.diff(p, prepend=-1) != 0) - 1
        open_bound = np.where(block < ix.n_blocks, bound, 0.0)
        upto = np.cumsum(open_bound)
        upto -= (upto[start] - open_bound[start])[group]
        reached = upto >= at_least
        # the pivot: the block of the first list with which the bounds reach the threshold
        pivot = np.minimum.reduceat(np.where(reached, block, ix.n_blocks), start)
        alive = (pivot < ix.n_blocks)[group]
        if not alive.any():
            break
        p, t, count, bound, cursor, block, to = (x[alive] for x in (p, t, count, bound, cursor, block, pivot[group]))
        behind = block < to
        cursor[behind] = np.searchsorted(ix.block_key, t[behind] * ix.n_blocks + to[behind])
        on = cursor < ix.list_end[t]
        on[on] = ix.block_key[cursor[on]] == t[on] * ix.n_blocks + to[on]
        c = cursor[on]
        start = np.flatnonzero(np.diff(p, prepend=-1))
        group = np.cumsum(np.diff(p, prepend=-1) != 0) - 1
        most = np.bincount(group[on], np.minimum(count[on], ix.block_count[c]) * ix.block_impact[c].astype(np.float64), len(start))
        enough = most >= block_least[to[start]] * (1 - 1e-6)
        got_p.append(p[start][enough])
        got_b.append(to[start][enough])
        cursor[on] += 1
    if not got_p:
        return none
    # the postings of the blocks that are left
    qp, qb = np.concatenate(got_p), np.concatenate(got_b)
    rows, q = _spread(np.searchsorted(kp, qp), np.searchsorted(kp, qp, "right"))
    n = len(ix.ids)
    low = kt[rows] * n + qb[q] * ITEM_BLOCK
    high = kt[rows] * n + np.minimum(qb[q] * ITEM_BLOCK + ITEM_BLOCK, n)
    post, r = _spread(np.searchsorted(ix.post_key, low), np.searchsorted(ix.post_key, high))
    item = ix.post_key[post] - kt[rows][r] * n
    common = np.minimum(kc[rows][r], ix.post_count[post])
    cell = q[r] * ITEM_BLOCK + item - qb[q[r]] * ITEM_BLOCK
    score = np.bincount(cell, common * ix.post_impact[post].astype(np.float64), len(qp) * ITEM_BLOCK)
    both = np.bincount(cell, common, len(qp) * ITEM_BLOCK)
    hit = np.flatnonzero(score > 0)
    of, item = hit // ITEM_BLOCK, qb[hit // ITEM_BLOCK] * ITEM_BLOCK + hit % ITEM_BLOCK
    good = (score[hit] >= least[item] * (1 - 1e-6)) & (both[hit] >= shared[item])
    return qp[of[good]], item[good]


def _common(mask: dict[int, int], n: int, seq: list[int]) -> int:
    """Length of the longest common subsequence of an item and ``seq``, bit-parallel."""
    full = (1 << n) - 1
    v = full
    get = mask.get
    for t in seq:
        m = get(t)
        if m:
            u = v & m
            v = (v + u) | (v - u)
    return n - (v & full).bit_count()


@lru_cache(4096)
def _places(ix: ItemIndex, j: int) -> dict[int, int]:
    """For each term of item j the bits of its places."""
    masks: dict[int, int] = {}
    for k, t in enumerate(ix.seq(j).tolist()):
        masks[t] = masks.get(t, 0) | 1 << k
    return masks


def _in_order(ix: ItemIndex, j: int, seq: np.ndarray) -> bool:
    """Whether a stretch of ``seq`` (term numbers, -1 for others) holds SHARE of item j's words in their order."""
    masks = _places(ix, j)
    n, need = len(ix.seq(j)), int(ix.need[j])
    at = [k for k, t in enumerate(seq.tolist()) if t in masks]
    own, span = [int(seq[k]) for k in at], STRETCH * n
    at = np.array(at)
    if _common(masks, n, own) < need:
        return False
    if len(seq) <= span:
        return True
    # stretches start at a word of the item; a stretch's best grows at most by the words that enter
    ends = np.searchsorted(at, at + span)
    k = 0
    while k < len(at):
        got = _common(masks, n, own[k : ends[k]]) if ends[k] - k >= need else ends[k] - k
        if got >= need:
            return True
        k = max(k + 1, int(np.searchsorted(ends, ends[k] + need - got)))
    return False


def _terms(ix: ItemIndex, text: str) -> np.ndarray:
    get = ix.written.get
    return np.array([get(w, -1) for w in _WORD.findall(text)], np.int64)


def candidates(ix: ItemIndex, seqs: list[np.ndarray], rule: int) -> list[tuple[int, int, int, int]]:
    """(sequence, item, first word, word after the last) of each passage that the index retrieves for the rule."""
    step, least, shared = ix.rules[rule]
    base, pos, term, total = [], [], [], 0
    for s in seqs:
        base.append(total)
        k = np.flatnonzero(s >= 0)
        pos.append(k + total)
        term.append(s[k])
        total += -(-len(s) // step) * step + step  # no passage holds words of two sequences
    if not seqs:
        return []
    x, t, base = np.concatenate(pos), np.concatenate(term), np.array(base)
    # a word lies in the passage that starts in its own step and in the one before
    tile = x // step
    earlier = tile * step > base[np.searchsorted(base, x, "right") - 1]
    p, items = retrieve(ix, np.concatenate((tile, tile[earlier] - 1)), np.concatenate((t, t[earlier])), least, shared)
    d = np.searchsorted(base, p * step, "right") - 1
    first = p * step - base[d]
    return list(zip(d.tolist(), items.tolist(), first.tolist(), (first + 2 * step).tolist()))


def find_repeats(ix: ItemIndex, texts: list[str | None]) -> list[tuple[int, int]]:
    """(text number, item_id) of every repeat.

    A text whose lines are numbered is looked at with and without the numbers, as an item may have numbered lines too.
    """
    of, seqs = [], []
    for d, text in enumerate(texts):
        if text:
            plain = undo_layout(text)
            bare = drop_numbers(plain)
            for t in (plain,) if bare is plain else (plain, bare):
                of.append(d)
                seqs.append(_terms(ix, t))
    found: set[tuple[int, int]] = set()
    asked: dict[int, set[int]] = {}
    for s, j, *_ in candidates(ix, seqs, 0):
        asked.setdefault(s, set()).add(j)
    for s, items in asked.items():
        found.update((of[s], j) for j in ix.runs(seqs[s]) & items)
    for s, j, a, b in candidates(ix, seqs, 1):
        if (of[s], j) not in found and _in_order(ix, j, seqs[s][a:b]):
            found.add((of[s], j))
    return sorted((d, int(ix.ids[j])) for d, j in found)


def build_indexes(items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(shard, index): pickled indexes of at most about ITEMS items of like length, each built in one task."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(words)

    rows = items.select(F.col(f"`{item}`").cast("bigint").alias("i"), cut(F.col(f"`{item_text}`").cast("string")).alias("w")).filter("i IS NOT NULL AND size(w) > 0").distinct()
    rows = materialize(rows.withColumn("n", F.size("w")), "items")
    shards = -(-rows.count() // ITEMS)
    ends = rows.approxQuantile("n", [k / shards for k in range(1, shards)], 0.001) if shards > 1 else []
    length = F.lit(0)
    for e in sorted(set(ends)):
        length = length + F.when(F.col("n") > e, 1).otherwise(0)
    by_length = rows.withColumn("length", length)
    sizes = {r["length"]: -(-int(r["c"]) // ITEMS) for r in by_length.groupBy("length").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most shards rows
    parts = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.create_map(F.lit(0), F.lit(1))
    placed = by_length.withColumn("part", F.pmod(F.xxhash64("i", "w"), parts[F.col("length")]))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        listed = sorted((int(i), list(w)) for i, w in zip(pdf["i"], pdf["w"]))
        return pd.DataFrame({"index": [pickle.dumps(vars(ItemIndex(listed)))]})

    return materialize(placed.groupBy("length", "part").applyInPandas(build, "index binary").withColumn("shard", F.monotonically_increasing_id()), "indexes")


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(key, item) for every document that repeats an item, each pair once for each row of ``docs``.

    A document repeats an item if, layout undone, it holds RUN consecutive words of it, or SHARE of its words in order
    within a stretch of STRETCH times its length. Items are the stated query set, of any number: indexes of about ITEMS
    items are built in tasks and sent to the workers one after the other, and the corpus is scanned, whole texts and
    without a shuffle, once for each. Defined results: null or empty texts repeat nothing and null or empty items are
    never repeated; equal items are all reported; items of fewer than RUN words are found by the share alone.
    """
    kind = dict(docs.dtypes)[key]
    wanted, schema = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), f"`{key}` {kind}, `{item}` bigint"
    built = build_indexes(items, item, item_text)
    out = None
    for r in built.select("shard").orderBy("shard").collect():
        blob = built.filter(F.col("shard") == r["shard"]).select("index").first()[0]
        found = wanted.mapInArrow(_scan(Shared(docs.sparkSession, bytes(blob)), key, item), schema)
        out = found if out is None else out.unionByName(found)
    drop_table(built)
    return out if out is not None else wanted.filter(F.lit(False)).select(key, F.lit(None).cast("bigint").alias(item))


def _scan(shared: Shared, key: str, item: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = ItemIndex([])
        vars(ix).update(pickle.loads(shared.value))
        for b in batches:
            texts, o = b.column(1).to_pylist(), 0
            while o < len(texts):
                n, size = 0, 0
                while o + n < len(texts) and (n == 0 or size < 1 << 20) and n < 500:
                    size += len(texts[o + n] or "")
                    n += 1
                got = find_repeats(ix, texts[o : o + n])
                if got:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([o + d for d, _ in got])), pa.array([i for _, i in got], pa.int64())], names=[key, item])
                o += n

    return run
