"""What engraving a score needs, as rows: excerpts, lyric and chord lines, names, gaps, printed tuplets, glued syllables."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions.text import slug
from stavework.operators.windows import in_force

# Fixed values.
VOWELS = "aeiouyäöüàáâãåèéêëìíîïòóôõùúûýæœ"
DIPHTHONGS = {"ie", "ei", "ai", "au", "eu", "äu", "oi", "ou", "oo", "ee", "ae", "oe", "ay", "ey", "oy"}
GLYPH_WIDTHS = {"ijlI.,;:'!|": 0.28, "frt": 0.35, "cesz": 0.45, "abdghknopquvxy": 0.55, "mw": 0.8, "MW": 0.9}
MOST_PIECES, WORST_OFFSET = 4, 1.0


def excerpt(measures: DataFrame, staff: list[str], first: int, count: int) -> DataFrame:
    """The measures printed first .. first + count - 1, indexed anew; the first states clef, key and time in force.

    ``measures(staff..., m_idx, m_number, clef, key, time, ...)``; a number that isn't whole is in no excerpt.
    """
    d = measures
    for c in ("clef", "key", "time"):
        d = in_force(d, staff, ["m_idx"], c, f"__{c}")
    d = d.filter(F.expr("try_cast(m_number AS INT)").between(first, first + count - 1))
    w = Window.partitionBy(*staff).orderBy("m_idx")
    d = d.withColumn("__i", F.row_number().over(w) - 1)
    for c in ("clef", "key", "time"):
        d = d.withColumn(c, F.when(F.col("__i") == 0, F.col(f"__{c}")).otherwise(F.col(c)))
    return d.withColumn("m_idx", F.col("__i")).select(*measures.columns)


def lyric_line(events: DataFrame, staff: list[str]) -> DataFrame:
    """K9: per staff and verse the line of syllables of the lowest voice, ``_`` where a note has none.

    ``events(staff..., m_idx, voice_no, ev_ord, verse, text, continues)``, one row for each note that can carry a syllable and
    verse; tied continuations are skipped and trailing ``_`` trimmed. A line without a syllable gives no row.
    """
    d = events.withColumn("__v", F.min("voice_no").over(Window.partitionBy(*staff))).filter((F.col("voice_no") == F.col("__v")) & ~F.coalesce("continues", F.lit(False)))
    g = d.groupBy(*staff, "verse").agg(F.array_sort(F.collect_list(F.struct("m_idx", "ev_ord", F.coalesce("text", F.lit("_")).alias("t")))).alias("l"))
    line = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["t"]), " "), r"(?:(?:^| )_)+$", "")
    return g.select(*staff, "verse", line.alias("line")).filter("line <> ''")


def chord_spans(chords: DataFrame, score: str, ends: DataFrame, ticks: int) -> DataFrame:
    """Chords of the first staff that has any, snapped down to 1/32 quarter, each until the next or the score's end.

    ``chords(score, part_ord, staff_no, pos_ticks, name)``, ``ends(score, end_ticks)``. Of chords at one place the last stays.
    """
    ref = chords.withColumn("__s", F.min(F.struct("part_ord", "staff_no")).over(Window.partitionBy(score))).filter(F.struct("part_ord", "staff_no") == F.col("__s"))
    grid = F.lit(ticks // 32)
    d = ref.withColumn("at", F.col("pos_ticks") - F.pmod("pos_ticks", grid)).groupBy(score, "at").agg(F.max_by("name", "pos_ticks").alias("name"))
    d = d.withColumn("until", F.lead("at").over(Window.partitionBy(score).orderBy("at"))).join(ends, score)
    return d.select(score, "at", F.coalesce("until", "end_ticks").alias("until"), "name")


def part_slugs(parts: DataFrame, score: str) -> DataFrame:
    """A file name for each part; parts of one name get a to z, aa to zz, then numbers in order."""
    d = parts.withColumn("__s", F.coalesce(F.nullif(slug(F.coalesce("name", F.lit(""))), F.lit("")), F.lit("part")))
    w = Window.partitionBy(score, "__s")
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("part_ord"))
    letter = F.when(k <= 26, F.chr(96 + k)).when(k <= 702, F.concat(F.chr(96 + F.floor((k - 1) / 26)), F.chr(97 + (k - 1) % 26))).otherwise(k.cast("string"))
    return d.withColumn("slug", F.when(n > 1, F.concat("__s", F.lit("-"), letter)).otherwise(F.col("__s"))).drop("__s")


def without_lyrics(layout: DataFrame, voices: DataFrame) -> DataFrame:
    """Layout lines (path, line, text) without the lyrics of the named voices."""
    named = layout.withColumn("voice", F.nullif(F.regexp_extract("text", r'\\lyricsto\s+"?([A-Za-z]+)"?', 1), F.lit("")))
    return named.join(voices.select("voice"), "voice", "left_anti").select(*layout.columns)


def printed_tuplets(marks: DataFrame, events: DataFrame, key: list[str], within: float = 6.0) -> DataFrame:
    """J11, X9, card B: the run of plain notes that a printed 3 belongs to.

    ``marks(key..., mark, x, y)``, ``events(key..., voice_no, ev_ord, x, y, duration_ticks, plain)`` of one measure and staff, in
    staff spaces. A mark takes the run of 2 to 6 plain notes of one voice whose centre is nearest to it and whose total is
    three equal written values; of voices the nearest in height, then the lowest number. A note belongs to one mark only.
    Rows (key, mark, voice_no, first, n).
    """
    kinds = dict(marks.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in key) + ", mark bigint, voice_no int, first int, n int"

    def one(k: tuple, ms: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        rows, used = [], set()
        if len(es):
            for m in ms.sort_values(["x", "mark"]).itertuples():
                best = None
                for v, e in es.sort_values("ev_ord").groupby("voice_no"):
                    e = e.reset_index(drop=True)
                    for a in range(len(e)):
                        for n in range(2, 7):
                            run = e.iloc[a : a + n]
                            total = int(run["duration_ticks"].sum())
                            if len(run) < n or not run["plain"].all() or total % 3 or (total // 3) & (total // 3 - 1) and total // 3 % 45 or any((v, o) in used for o in run["ev_ord"]):
                                continue
                            centre = (float(run["x"].iat[0]) + float(run["x"].iat[-1])) / 2
                            off = (abs(centre - m.x), abs(float(run["y"].mean()) - m.y), int(v), a, n)
                            if off[1] <= within and (best is None or off < best[0]):
                                best = (off, int(v), int(run["ev_ord"].iat[0]), n, [(v, o) for o in run["ev_ord"]])
                if best:
                    used.update(best[4])
                    rows.append((*k, int(m.mark), best[1], best[2], best[3]))
        return pd.DataFrame(rows, columns=[*key, "mark", "voice_no", "first", "n"])

    return marks.groupBy(*key).cogroup(events.groupBy(*key)).applyInPandas(one, out)


def width(ch: str) -> float:
    return next((w for chars, w in GLYPH_WIDTHS.items() if ch in chars), 0.7 if ch.isupper() else 0.5)


def split_word(text: str, x: float, w: float, anchors: list[tuple[float, float, bool]]) -> list[str] | None:
    """X7, card J: a word glued over several notes, in one piece for each, or None if no split fits.

    ``anchors`` are (centre, left edge, melisma) of the notes. Each piece needs a vowel, no cut parts a diphthong; the split
    with the least worst distance of a piece's centre from its note counts, if that is within WORST_OFFSET average glyphs.
    """
    n, k = len(text), len(anchors)
    if not 2 <= k <= MOST_PIECES or n < k:
        return None
    glyphs = [width(c) for c in text]
    scale = w / sum(glyphs)
    edge = [x]
    for g in glyphs:
        edge.append(edge[-1] + g * scale)
    best: tuple[float, list[str]] | None = None
    for cuts in combinations(range(1, n), k - 1):
        if any(text[c - 1 : c + 1].lower() in DIPHTHONGS for c in cuts):
            continue
        b = [0, *cuts, n]
        pieces = [text[p:q] for p, q in zip(b, b[1:])]
        if not all(any(c in VOWELS for c in p.lower()) for p in pieces):
            continue
        off = 0.0
        for p, q, (centre, left, melisma) in zip(b, b[1:], anchors):
            d = abs((edge[p] + edge[q]) / 2 - centre)
            off = max(off, min(d, abs(edge[p] - left)) if melisma else d)
        off /= w / n
        if best is None or off < best[0]:
            best = (off, pieces)
    return best[1] if best and best[0] <= WORST_OFFSET else None


def split_words(words: DataFrame) -> DataFrame:
    """``words(..., text, x, w, anchors array<struct<centre,left,melisma>>)`` with ``pieces``, null where nothing fits."""

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series, x: pd.Series, w: pd.Series, anchors: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or a is None else split_word(t, float(p), float(q), [(v["centre"], v["left"], v["melisma"]) for v in a]) for t, p, q, a in zip(text, x, w, anchors)])

    return words.withColumn("pieces", pieces("text", "x", "w", "anchors"))


def spacing_fit(x: Column, room: Column) -> tuple[Column, Column]:
    """slope and RMS misfit of x against room, as aggregates; a slope of 0 or less has an infinite misfit."""
    n, slope = F.count(x), F.regr_slope(x, room)
    sse = (F.var_pop(x) - slope * F.covar_pop(x, room)) * n
    return slope, F.when(slope > 0, F.sqrt(F.greatest(sse, F.lit(0.0)) / n)).otherwise(F.lit(float("inf")))
