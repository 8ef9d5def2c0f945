"""Persons behind names as they are written in catalogue fields."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.runtime import materialize

#: Fillers that name nobody, folded.
NOBODY = {"", "-", "--", "_", "?", "anon", "anon.", "anonymous", "folk", "n/a", "na", "n.n.", "nn", "none", "null", "trad", "trad.", "traditional", "unknown", "various", "staffpress"}
#: Letters that Unicode doesn't decompose.
_LETTERS = str.maketrans({"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_SEVERAL = re.compile(r"\s*(?:;|&|\+|\band\b|\bund\b|\bet\b)\s*")
_TITLE = re.compile(r"^(?:eng|ed|engr|arr)\.\s*(?:by\s+)?|^(?:engraved|edited) by\s+")


def fold(text: str) -> str:
    """Lower case, without accents, with single blanks for blanks and underscores."""
    text = unicodedata.normalize("NFKD", text.translate(_LETTERS).replace("_", " "))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).lower().split())


def person(name: str) -> tuple[str, str] | None:
    """(surname, given name) of one folded name, the given name without its dot; None where it names nobody."""
    name = _TITLE.sub("", name).strip()
    if name in NOBODY or not any(c.isalpha() for c in name):
        return None
    if "," in name:
        surname, _, given = name.partition(",")
    elif " " in name:
        given, _, surname = name.rpartition(" ")
    elif "." in name.strip("."):
        given, _, surname = name.strip(".").rpartition(".")
    else:
        given, surname = "", name
    surname, given = surname.strip(" ."), given.strip(" .")
    return None if surname in NOBODY else (surname, given)


def persons(field: str | None, several: bool) -> list[str]:
    """The persons a field names, each as ``surname|given``."""
    if not field:
        return []
    folded = fold(field)
    if folded in NOBODY:
        return []
    parts = _SEVERAL.split(folded) if several else [folded]
    return [f"{p[0]}|{p[1]}" for p in map(person, parts) if p]


def near(a: str, b: str) -> bool:
    """Slightly misspelt: one letter more, less, other or swapped with its neighbour; of equal letters two such changes."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    most = 2 if sorted(a) == sorted(b) else 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if most == 1:
        return max(len(a), len(b)) <= 1
    # equal letters, other ends: neighbours swapped at both ends, any two letters swapped, or one moved
    swapped = a[:2] == b[1::-1] and (len(a) == 2 or len(a) > 3 and a[2:-2] == b[2:-2] and a[-2:] == b[:-3:-1])
    return swapped or a[0] == b[-1] and a[-1] == b[0] and a[1:-1] == b[1:-1] or a[1:] == b[:-1] or a[:-1] == b[1:]


def _others(g: str) -> Iterator[str]:
    """All ways with the letters of ``g`` that are near it."""
    n = len(g)
    for i in range(n):
        rest = g[:i] + g[i + 1 :]
        for j in range(n):
            yield rest[:j] + g[i] + rest[j:]
            if j > i:
                yield g[:i] + g[j] + g[i + 1 : j] + g[i] + g[j + 1 :]
    pairs = [i for i in range(n - 1) if g[i] != g[i + 1]]
    for i in pairs:
        for j in pairs:
            if j > i + 1:
                yield g[:i] + g[i + 1] + g[i] + g[i + 2 : j] + g[j + 1] + g[j] + g[j + 2 :]


def _hash(g: str) -> int:
    h = 0
    for x in g:
        h = (h * _BASE + ord(x)) % _PRIME
    return h


def _left_out(g: str) -> list[tuple[int, int]]:
    """For each place the word without its letter, as (place, hash)."""
    before, after, power, n = [0], [0], [1], len(g)
    for x, y in zip(g, reversed(g)):
        before.append((before[-1] * _BASE + ord(x)) % _PRIME)
        after.append((after[-1] + ord(y) * power[-1]) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    return [(i, (before[i] * power[n - 1 - i] + after[n - 1 - i]) % _PRIME) for i in range(n)]


def _near_pairs(full: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs that join all that are near, directly or through others; the work follows the number of ways, not its square."""
    known, whole = set(full), {_hash(g): g for g in full}
    same: dict[tuple[int, int], str] = {}
    letters: dict[str, list[str]] = defaultdict(list)
    for g in full:
        if len(g) < 3:
            continue
        letters["".join(sorted(g))].append(g)
        for key in _left_out(g):
            other = same.setdefault(key, g)
            if other != g and near(other, g):  # one letter other: without it they are equal
                yield other, g
            if key[1] in whole and near(g, whole[key[1]]):  # one letter less
                yield g, whole[key[1]]
    for ways in letters.values():  # equal letters: the cheaper of all pairs and all ways to change one
        if len(ways) - 1 <= 2 * len(ways[0]) ** 2:
            yield from ((a, b) for a, b in combinations(ways, 2) if near(a, b))
        else:
            yield from ((g, x) for g in ways for x in known.intersection(_others(g)))


def resolve(given: list[str]) -> dict[str, str | None]:
    """Which person of one surname each way of writing the given name means: its person's first way, or None if unclear.

    Full names that are near join. A name cut short joins the only person it can begin; a missing one the only
    person there is.
    """
    ways = sorted(set(given))
    full = [g for g in ways if len(g) > 1]
    root = {g: g for g in ways}

    def find(g: str) -> str:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    for a, b in _near_pairs(full):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    for g in sorted(full, key=len):  # cut short without a dot; what begins with g follows it in order
        begun = takewhile(lambda x: x.startswith(g), map(full.__getitem__, range(bisect_left(full, g), len(full))))
        longer = {find(x) for x in begun if len(x) > len(g) + 1 and find(x) != find(g)}
        if len(longer) == 1:
            root[find(g)] = longer.pop()
    out: dict[str, str | None] = {g: find(g) for g in full}
    for g in (g for g in ways if len(g) == 1):
        starts = {p for x, p in out.items() if x.startswith(g) and len(x) > 1}
        out[g] = starts.pop() if len(starts) == 1 else None if starts else g
    if "" in root:
        people = {p for p in out.values() if p is not None}
        out[""] = people.pop() if len(people) == 1 else None if people else ""
    return out


def with_persons(df: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """(key, field, person) for each person that a field names; a person is one string, ``surname|given name``.

    ``fields`` says of each field whether it can name several. All are read in one pass. Names are resolved within a
    field and surname over their distinct ways of writing, which a hash aggregate with map-side combine finds first:
    however many rows name a person, a surname's run holds only the ways. Null, empty and filler fields, and names that
    fit several persons, give no row.
    """
    several = list(fields.values())

    @F.pandas_udf("array<struct<field: int, written: string>>")
    def read(s: pd.DataFrame) -> pd.Series:
        columns = [s[c] for c in s]
        return pd.Series([[{"field": i, "written": p} for i, x in enumerate(row) for p in persons(x, several[i])] for row in zip(*columns)])

    named = df.select(F.col(key).alias("key"), F.explode(read(F.struct(*[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)]))).alias("n"))
    names = materialize(named.select("key", "n.field", "n.written"), "names")
    ways = names.select("field", "written").distinct().withColumn("surname", F.substring_index("written", "|", 1))

    def surnames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ways come in order of field and surname; a surname is resolved when the next begins."""
        own, held, rows = None, [], []
        for b in batches:
            for field, surname, written in zip(*(c.to_pylist() for c in b.columns)):
                if (field, surname) != own and held:
                    rows += resolved(*own, held)
                    held = []
                own = field, surname
                held.append(written)
            if len(rows) >= 10_000:
                yield batch(rows)
                rows = []
        yield batch(rows + (resolved(*own, held) if held else []))

    def resolved(field: int, own: str, written: list[str]) -> list[tuple[int, str, str]]:
        means = resolve([w.partition("|")[2] for w in written])
        persons = [(w, means[w.partition("|")[2]]) for w in written]
        return [(field, w, f"{own}|{p}") for w, p in persons if p is not None]

    def batch(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        arrays = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))]
        return pa.RecordBatch.from_arrays(arrays, names=["field", "written", "person"])

    by_surname = ways.select("field", "surname", "written").repartition("field", "surname").sortWithinPartitions("field", "surname", "written")
    means = by_surname.mapInArrow(surnames, "field int, written string, person string")
    field = F.element_at(F.array(*[F.lit(c) for c in fields]), F.col("field") + 1)
    return names.join(means, ["field", "written"]).select("key", field.alias("field"), "person").distinct()
