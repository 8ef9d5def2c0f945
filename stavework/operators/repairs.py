"""Repairs as ``rows -> (rows, log)``: nothing is edited in place, each repair leaves a log row.

Rules that choose greedily or search run as grouped pandas functions, a score or a column of measures at a time; the
others are DataFrame expressions.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions import music
from stavework.functions.text import names_compatible, stray
from stavework.operators.sets import loudest_voices

#: Solutions found over both budgets, from which a voice's search stops; what is tried isn't counted.
MOST_SOLUTIONS = 64
#: What page text in a lyric line looks like.
PAGE_TEXT = r"(?i)copyright|©|all rights|www\.|https?:|\bop\.\s*\d|\bpage\b|\bedition\b"


# --- X2, card F: voices that miss or exceed the measure by misread values


def solutions(durations: list[int], starts: list[int], plain: list[bool], target: int) -> list[tuple[tuple[str, int], ...]]:
    """Edits that make a voice fill ``target`` ticks: any triplets on three equal plain notes, with at most one of dot,
    undot, double, halve. A triplet starts on a multiple of twice the note, after the edits before it. The walk stops when
    it has found MOST_SOLUTIONS; those without a single edit are met, and count, in both budgets."""
    n = len(durations)
    moves: list[list[tuple[str | None, int, int, int]]] = []  # edit, events, ticks, single edits
    for i, d in enumerate(durations):
        here: list[tuple[str | None, int, int, int]] = [(None, 1, d, 0)]
        if d and i + 3 <= n and all(plain[i : i + 3]) and d == durations[i + 1] == durations[i + 2]:
            here.append(("triplet", 3, 2 * d, 0))  # three in the time of two
        if d:
            here += [("dot", 1, d * 3 // 2, 1)] if plain[i] else [("undot", 1, d * 2 // 3, 1)]
            here += [("double", 1, d * 2, 1), ("halve", 1, d // 2, 1)]
        moves.append(here)
    start = starts[0] if starts else 0
    # ends[left][i]: positions at event i from which the target is met with so many single edits left; the walk takes
    # no other, so its work follows what it finds
    ends = [[set() for _ in range(n)] + [{target}] for _ in range(2)]
    for left in range(2):
        for i in reversed(range(n)):
            for edit, events, ticks, singles in moves[i]:
                if singles <= left:
                    ends[left][i].update(p - ticks for p in ends[left - singles][i + events] if p - ticks >= start and (edit != "triplet" or (p - ticks) % ticks == 0))
    out: list[tuple[tuple[str, int], ...]] = []
    found = 0
    for budget in range(2):
        stack: list[tuple[int, int, int, tuple[tuple[str, int], ...]]] = [(0, start, budget, ())]
        while stack and found < MOST_SOLUTIONS:
            i, pos, left, edits = stack.pop()
            if pos not in ends[left][i]:
                continue
            if i < n:
                for edit, events, ticks, singles in reversed(moves[i]):
                    if singles <= left and (edit != "triplet" or pos % ticks == 0):
                        stack.append((i + events, pos + ticks, left - singles, (*edits, (edit, i)) if edit else edits))
            elif edits:
                found += 1
                if not left:
                    out.append(edits)
    return out


def apply(durations: list[int], edits: tuple[tuple[str, int], ...]) -> list[int]:
    d = list(durations)
    for name, i in edits:
        if name == "triplet":
            for j in range(i, i + 3):
                d[j] = d[j] * 2 // 3
        else:
            d[i] = {"dot": d[i] * 3 // 2, "undot": d[i] * 2 // 3, "double": d[i] * 2, "halve": d[i] // 2}[name]
    return d


def rhythm_repairs(events: DataFrame, ticks: str = "duration_ticks") -> DataFrame:
    """(score_id, m_idx, part_ord, staff_no, voice_no, edits, confirmed) for voices that an unambiguous edit makes fill.

    ``events(score_id, m_idx, part_ord, staff_no, voice_no, ev_ord, duration_ticks, plain, confidence, expected, edge)``;
    ``edge`` marks first and last measures, of which short voices stay. A solution ranks by single edits, agreement of
    onsets with the column's voices that fill as read, mean confidence of what it edits, and misreads; if the first two
    draw, nothing is done. A single edit that doesn't raise the agreement is unconfirmed; unconfirmed edits of missed
    symbols count if two voices or more of the column have the same and no other has as many.
    """

    def column(rows: list[dict]) -> list[dict]:
        rows = sorted(rows, key=lambda r: (r["part_ord"], r["staff_no"], r["voice_no"], r["ev_ord"]))
        voices = [(k, list(v)) for k, v in groupby(rows, key=lambda r: (r["part_ord"], r["staff_no"], r["voice_no"]))]
        trusted: set[int] = set()
        for _, v in voices:
            d = [int(e["d"]) for e in v]
            if sum(d) == v[0]["expected"]:
                trusted.update(accumulate([0, *d[:-1]]))
        found = []
        for k, v in voices:
            d, want = [int(e["d"]) for e in v], int(v[0]["expected"])
            if sum(d) == want or (v[0]["edge"] and sum(d) < want):
                continue
            conf = [1.0 if e["confidence"] is None or e["confidence"] != e["confidence"] else float(e["confidence"]) for e in v]
            agree = lambda dd: sum(t in trusted for t in accumulate([0, *dd[:-1]]))
            ranked = sorted(
                ((sum(name != "triplet" for name, _ in s), -agree(apply(d, s)), sum(conf[i] for _, i in s) / len(s), sum(name in ("double", "halve") for name, _ in s)), s)
                for s in solutions(d, list(accumulate([0, *d[:-1]])), [bool(e["plain"]) for e in v], want)
            )
            if not ranked or (len(ranked) > 1 and ranked[0][0] == ranked[1][0]):
                continue
            best = ranked[0][1]
            single = any(name != "triplet" for name, _ in best)
            found.append((k, best, not single or agree(apply(d, best)) > agree(d)))
        signs = Counter(tuple(sorted(s)) for _, s, ok in found if not ok and all(n in ("dot", "triplet") for n, _ in s))
        top = signs.most_common(2)
        winner = top[0][0] if top and top[0][1] >= 2 and (len(top) == 1 or top[0][1] > top[1][1]) else None
        return [{"part_ord": k[0], "staff_no": k[1], "voice_no": k[2], "edits": " ".join(f"{n}@{i}" for n, i in s), "confirmed": ok or tuple(sorted(s)) == winner} for k, s, ok in found]

    @F.pandas_udf("array<struct<part_ord:int,staff_no:int,voice_no:int,edits:string,confirmed:boolean>>")
    def repaired(columns: pd.Series) -> pd.Series:
        return pd.Series([column(list(c)) for c in columns])

    # only columns with a voice that doesn't fill go to Python
    voice = ["part_ord", "staff_no", "voice_no"]
    d = events.groupBy("score_id", "m_idx", *voice).agg(F.sum(ticks).alias("__t"), F.max("expected").alias("__e"), F.collect_list(F.struct(*voice, "ev_ord", F.col(ticks).alias("d"), "plain", "confidence", "expected", "edge")).alias("__v"))
    c = d.groupBy("score_id", "m_idx").agg(F.bool_or(F.col("__t") != F.col("__e")).alias("__off"), F.flatten(F.collect_list("__v")).alias("__c")).filter("__off")
    return c.select("score_id", "m_idx", F.explode(repaired("__c")).alias("r")).select("score_id", "m_idx", "r.*")


# --- X1, card I: parts that are one


def merge_parts(parts: DataFrame, presence: DataFrame) -> DataFrame:
    """(score_id, part_ord, cluster): parts never present together, of one shape and with compatible names, in turn.

    ``parts(score_id, part_ord, name, n_staves, clefs)``, ``presence(score_id, part_ord, m_idx)``. Parts come by first
    present measure; one joins the only cluster that takes it; a part that none or several would take starts its own.
    Parts never present have no row.
    """
    p = presence.groupBy("score_id", "part_ord").agg(F.array_sort(F.collect_set("m_idx")).alias("at"))
    d = parts.join(p, ["score_id", "part_ord"])
    left = d.select("score_id", F.col("part_ord").alias("a"), F.col("name").alias("an"))
    right = d.select("score_id", F.col("part_ord").alias("b"), F.col("name").alias("bn"))
    fits = left.join(right, "score_id").filter((F.col("a") < F.col("b")) & names_compatible(F.col("an"), F.col("bn"))).groupBy("score_id").agg(F.collect_set(F.struct("a", "b")).alias("fits"))
    d = d.groupBy("score_id").agg(F.collect_list(F.struct("part_ord", "n_staves", F.col("clefs").cast("string").alias("clefs"), "at")).alias("p")).join(fits, "score_id", "left")

    @F.pandas_udf("array<struct<part_ord:int,cluster:int>>")
    def cluster(all_parts: pd.Series, all_fits: pd.Series) -> pd.Series:
        out = []
        for ps, fs in zip(all_parts, all_fits):
            pairs = {(f["a"], f["b"]) for f in (fs if fs is not None else [])}
            pairs |= {(b, a) for a, b in pairs}
            groups: list[tuple[list, set]] = []
            rows = []
            for x in sorted(ps, key=lambda x: (min(x["at"]), x["part_ord"])):
                at = set(x["at"])
                ok = [g for g in groups if not g[1] & at and all(y["n_staves"] == x["n_staves"] and y["clefs"] == x["clefs"] and (y["part_ord"], x["part_ord"]) in pairs for y in g[0])]
                if len(ok) == 1:
                    ok[0][0].append(x)
                    ok[0][1].update(at)
                else:
                    groups.append(([x], at))
            for g, _ in groups:
                rows += [{"part_ord": int(x["part_ord"]), "cluster": int(g[0]["part_ord"])} for x in g]
            out.append(rows)
        return pd.Series(out)

    return d.select("score_id", F.explode(cluster("p", "fits")).alias("r")).select("score_id", "r.*")


# --- X4: a tenor's G clef without its 8


def octave_clef(staves: DataFrame, notes: DataFrame) -> DataFrame:
    """Staves to be read an octave lower: the only staff of a tenor, a plain G clef throughout, median midi 62 or more.

    ``staves(score_id, part_ord, name, n_staves, clefs array<struct<sign,octave_change>>)``, ``notes(score_id, part_ord, step, alter, octave)``.
    """
    tenor = staves.filter((F.col("n_staves") == 1) & F.lower("name").rlike(r"tenor|^t\.?$") & F.forall("clefs", lambda c: (c["sign"] == "G") & (F.coalesce(c["octave_change"], F.lit(0)) == 0)))
    m = notes.join(tenor.select("score_id", "part_ord"), ["score_id", "part_ord"]).groupBy("score_id", "part_ord").agg(F.median(music.midi(F.col("step"), F.col("alter"), F.col("octave"))).alias("median_midi"))
    return m.filter("median_midi >= 62")


# --- X5, card H: notes under octave lines


def under_octave_lines(notes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Notes with octaves moved by the lines over them.

    ``lines(keys..., start_pos, stop_pos, octaves)`` as half-open ranges of ``pos`` (a place that orders all events of the
    staff). A note under several lines moves by their sum.
    """
    l = lines.select(*[F.col(k).alias(f"__l_{k}") for k in keys], "start_pos", "stop_pos", "octaves")  # noqa: E741
    cond = (F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("stop_pos"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__l_{k}"))
    # lines are marks of their own, far fewer than notes: at most as many as match by key are compared
    d = notes.withColumn("__id", F.monotonically_increasing_id())
    moved = d.join(l, cond).groupBy("__id").agg(F.sum("octaves").alias("__o"))
    return d.join(moved, "__id", "left").withColumn("octave", F.col("octave") + F.coalesce("__o", F.lit(0))).drop("__id", "__o")


# --- X6, card J: lines of lyrics that are none


def clean_lyrics(lyrics: DataFrame, line: list[str]) -> DataFrame:
    """What becomes of each lyric line: ``action`` is page-text, chords, stray or keep, with its syllables if kept.

    ``lyrics(line keys..., ord, text)``. A line with page text goes; one of which three quarters parse as chord names,
    one of them more than a letter, is chords; one of strays only goes; else syllables without a letter are dropped.
    """
    c = music.parse_chord(F.col("text"))
    decorated = c.isNotNull() & ((c["kind"] != "major") | c["bass"].isNotNull() | (F.length(c["root"]) > 1))
    d = lyrics.withColumn("__page", F.col("text").rlike(PAGE_TEXT)).withColumn("__chord", c.isNotNull()).withColumn("__deco", decorated).withColumn("__stray", stray(F.col("text")))
    g = d.groupBy(*line).agg(
        F.bool_or("__page").alias("page"), F.avg(F.col("__chord").cast("double")).alias("share"), F.bool_or("__deco").alias("deco"), F.bool_and("__stray").alias("strays"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("text").rlike(r"\p{L}"), F.struct("ord", "text")))), lambda x: x["text"]).alias("syllables"),
    )
    action = F.when(F.coalesce("page", F.lit(False)), "page-text").when((F.col("share") >= 0.75) & F.col("deco"), "chords").when(F.coalesce("strays", F.lit(True)), "stray").otherwise("keep")
    return g.select(*line, action.alias("action"), F.when(action == "keep", F.col("syllables")).alias("syllables"))


def renumber_verses(lines: DataFrame, system: list[str], verse: str = "verse") -> DataFrame:
    """The verses left in each system numbered from 1."""
    return lines.withColumn("new_verse", F.dense_rank().over(Window.partitionBy(*system).orderBy(verse)))


# --- X8, card K: keys


def key_vote(readings: DataFrame, keys: list[str]) -> DataFrame:
    """A14 for keys: the most frequent, then the one of most accidentals; null if still drawn."""
    n = readings.filter("fifths IS NOT NULL").groupBy(*keys, "fifths").agg(F.count(F.lit(1)).alias("n"))
    best = n.withColumn("__r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc(F.abs("fifths"))))).filter("__r = 1")
    return best.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.min("fifths")).alias("fifths"))


def respell(notes: DataFrame, measure: list[str]) -> DataFrame:
    """Notes respelt from ``old_key`` to ``new_key``.

    ``notes(measure..., pos, step, alter, octave, accidental_shown, old_key, new_key)``. A note without a printed
    accidental whose alteration is the old key's takes the new key's; a printed one holds for its step and octave to the
    barline.
    """
    w = Window.partitionBy(*measure, "step", "octave").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = F.max(F.col("accidental_shown").cast("int")).over(w) == 1
    old, new = music.key_alter(F.col("old_key"), F.col("step")), music.key_alter(F.col("new_key"), F.col("step"))
    d = notes.withColumn("__held", held)
    return d.withColumn("alter", F.when(~F.col("__held") & (F.coalesce("alter", F.lit(0)) == old), new).otherwise(F.col("alter"))).drop("__held")


# --- X10, card L: parts to two staves


def reduction(events: DataFrame) -> DataFrame:
    """Voices for a piano: parts of a median below middle C go to the lower staff; voices of one rhythm become one.

    ``events(score_id, part_ord, staff_no, m_idx, voice_no, offset_ticks, duration_ticks, grace, kind, midis array<int>)``. Rows
    (score_id, m_idx, staff, place, n_voices, pitches): at most four voices a staff, numbered from the highest.
    """
    med = events.select("score_id", "part_ord", F.explode("midis").alias("m")).groupBy("score_id", "part_ord").agg(F.median("m").alias("med"))
    d = events.join(med, ["score_id", "part_ord"], "left").withColumn("staff", F.when(F.coalesce(F.col("med") < 60, F.lit(False)), 2).otherwise(1))
    one = F.struct("offset_ticks", "grace", "duration_ticks", (F.col("kind") == "rest").alias("rest"))
    v = d.groupBy("score_id", "m_idx", "staff", "part_ord", "staff_no", "voice_no").agg(F.array_sort(F.collect_list(one)).alias("rhythm"), F.flatten(F.collect_list("midis")).alias("p"))
    m = v.groupBy("score_id", "m_idx", "staff", "rhythm").agg(F.count(F.lit(1)).alias("n_voices"), F.array_sort(F.flatten(F.collect_list("p"))).alias("pitches"), F.min(F.struct("part_ord", "staff_no", "voice_no")).alias("first"))
    mid = F.call_function("div", F.size("pitches").cast("bigint"), F.lit(2).cast("bigint")).cast("int")
    m = m.withColumn("height", F.when(F.size("pitches") > 0, F.get("pitches", mid).cast("double")))
    return loudest_voices(m, ["score_id", "m_idx", "staff"], "height", "first").select("score_id", "m_idx", "staff", "place", "n_voices", "pitches")
