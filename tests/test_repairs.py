"""Repairs and combining on small cases."""

import random

from pyspark.sql import functions as F

from stavework.operators import combine, repairs


def test_rhythm(spark):
    assert (("triplet", 0),) in repairs.solutions([12, 12, 12, 24], [0, 12, 24, 36], [True] * 4, 48)
    assert repairs.apply([12, 12, 12, 24], (("triplet", 0),)) == [8, 8, 8, 24]
    cols = "score_id string, m_idx int, part_ord int, staff_no int, voice_no int, ev_ord int, duration_ticks bigint, plain boolean, confidence double, expected bigint, edge boolean"
    good = [("s", 1, 0, 1, 1, k, 24, True, 0.9, 48, False) for k in range(2)]
    bad = [("s", 1, 1, 1, 1, k, d, True, 0.9, 48, False) for k, d in enumerate([12, 12, 12, 24])]
    fine = [("s", 2, 0, 1, 1, 0, 48, True, 0.9, 48, False)]
    short = [("s", 3, 0, 1, 1, 0, 12, True, 0.9, 48, True)]
    got = [tuple(r) for r in repairs.rhythm_repairs(spark.createDataFrame(good + bad + fine + short, cols)).collect()]
    assert got == [("s", 1, 1, 1, 1, "triplet@0", True)]


def walked(durations, plain, target):
    """The reference's walk, step by step and without a cap."""

    def walk(i, pos, edits, budget):
        if pos > target:
            return
        if i == len(durations):
            if pos == target and edits:
                yield edits
            return
        d = durations[i]
        yield from walk(i + 1, pos + d, edits, budget)
        if durations[i : i + 3] == [d] * 3 and all(plain[i : i + 3]) and pos % (2 * d) == 0:
            yield from walk(i + 3, pos + 2 * d, (*edits, ("triplet", i)), budget)
        if budget:
            for name, new in (("dot", d * 3 // 2), ("undot", d * 2 // 3), ("double", d * 2), ("halve", d // 2)):
                if (name != "dot" or plain[i]) and (name != "undot" or not plain[i]):
                    yield from walk(i + 1, pos + new, (*edits, (name, i)), budget - 1)

    return [e for budget in range(2) for e in walk(0, 0, (), budget) if sum(name != "triplet" for name, _ in e) == budget]


def starts(durations):
    return [sum(durations[:i]) for i in range(len(durations))]


def test_rhythm_triplets_in_a_row(spark):
    assert (("triplet", 0), ("triplet", 3)) in repairs.solutions([12] * 6, starts([12] * 6), [True] * 6, 48)
    seven = repairs.solutions([12] * 7, starts([12] * 7), [True] * 7, 60)
    assert (("triplet", 0), ("triplet", 3)) in seven and (("triplet", 0), ("triplet", 4)) not in seven
    rng = random.Random(5)
    for _ in range(300):
        d = [rng.choice([12, 12, 12, 24, 36]) for _ in range(rng.randint(1, 8))]
        plain, target = [x != 36 and rng.random() < 0.9 for x in d], rng.choice([48, 60, 72, 96])
        want = walked(d, plain, target)
        if len(want) < repairs.MOST_SOLUTIONS // 2:
            assert repairs.solutions(d, starts(d), plain, target) == want
    cols = "score_id string, m_idx int, part_ord int, staff_no int, voice_no int, ev_ord int, duration_ticks bigint, plain boolean, confidence double, expected bigint, edge boolean"
    good = [("s", 1, 0, 1, 1, k, 24, True, 0.9, 48, False) for k in range(2)]
    bad = [("s", 1, 1, 1, 1, k, 12, True, 0.9, 48, False) for k in range(6)]
    got = [tuple(r) for r in repairs.rhythm_repairs(spark.createDataFrame(good + bad, cols)).collect()]
    assert got == [("s", 1, 1, 1, 1, "triplet@0 triplet@3", True)]


def test_rhythm_long_voices():
    for n in (24, 48):  # sets of many triplets come last
        every = tuple(("triplet", i) for i in range(0, n, 3))
        assert repairs.solutions([12] * n, starts([12] * n), [True] * n, 8 * n) == [every]
    # only solutions found count
    assert len(repairs.solutions([12] * 48, starts([12] * 48), [True] * 48, 44 * 12)) == repairs.MOST_SOLUTIONS


def test_parts(spark):
    parts = spark.createDataFrame([("s", 0, "Flute", 1, ["G"]), ("s", 1, "Fl.", 1, ["G"]), ("s", 2, "Piano", 2, ["G"]), ("s", 3, "Oboe", 1, ["G"])], "score_id string, part_ord int, name string, n_staves int, clefs array<string>")
    at = spark.createDataFrame([("s", 0, 0), ("s", 0, 1), ("s", 1, 2), ("s", 2, 0), ("s", 2, 2)], "score_id string, part_ord int, m_idx int")
    assert sorted(tuple(r) for r in repairs.merge_parts(parts, at).collect()) == [("s", 0, 0), ("s", 1, 0), ("s", 2, 2)]


def test_lyrics_and_keys(spark):
    rows = [(1, 0, "Copyright 1900"), (1, 1, "la"), (2, 0, "Am7"), (2, 1, "F#"), (3, 0, ".."), (3, 1, "k"), (4, 0, "glo"), (4, 1, "--"), (4, 2, "ria")]
    got = {r.line: (r.action, r.syllables) for r in repairs.clean_lyrics(spark.createDataFrame(rows, "line int, ord int, text string"), ["line"]).collect()}
    assert got == {1: ("page-text", None), 2: ("chords", None), 3: ("stray", None), 4: ("keep", ["glo", "ria"])}
    votes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", -2), ("c", None)], "k string, fifths int")
    assert sorted(tuple(r) for r in repairs.key_vote(votes, ["k"]).collect()) == [("a", 2), ("b", None)]
    n = spark.createDataFrame([(0, 0, "F", 0, 4, False), (0, 1, "F", 1, 4, True), (0, 2, "F", 0, 4, False), (0, 3, "C", 0, 4, False)], "m int, pos int, step string, alter int, octave int, accidental_shown boolean")
    out = repairs.respell(n.withColumn("old_key", F.lit(0)).withColumn("new_key", F.lit(1)), ["m"]).orderBy("pos").collect()
    assert [r.alter for r in out] == [1, 1, 0, 0]


def test_clef_and_lines(spark):
    st = spark.createDataFrame([("s", 0, "Tenor", 1, [("G", None)]), ("s", 1, "Tenor", 1, [("G", -1)])], "score_id string, part_ord int, name string, n_staves int, clefs array<struct<sign:string,octave_change:int>>")
    n = spark.createDataFrame([("s", p, "E", 0, 4) for p in (0, 1)], "score_id string, part_ord int, step string, alter int, octave int")
    assert [r.part_ord for r in repairs.octave_clef(st, n).collect()] == [0]
    notes = spark.createDataFrame([("s", i, 4) for i in range(4)], "k string, pos int, octave int")
    lines = spark.createDataFrame([("s", 1, 3, 1)], "k string, start_pos int, stop_pos int, octaves int")
    assert [r.octave for r in repairs.under_octave_lines(notes, lines, ["k"]).orderBy("pos").collect()] == [4, 5, 5, 4]


def test_reduction(spark):
    cols = "score_id string, part_ord int, staff_no int, m_idx int, voice_no int, offset_ticks bigint, duration_ticks bigint, grace boolean, kind string, midis array<int>"
    rows = [("s", p, 1, 0, 1, 0, 48, False, "note", [m]) for p, m in enumerate([72, 67, 50])] + [("s", 3, 1, 0, 1, 0, 24, False, "note", [64])]
    got = sorted((r.staff, r.place, r.n_voices, r.pitches) for r in repairs.reduction(spark.createDataFrame(rows, cols)).collect())
    assert got == [(1, 1, 2, [67, 72]), (1, 2, 1, [64]), (2, 1, 1, [50])]


def test_alignment(spark):
    m = lambda i, on, silent=False: (i, on, silent, False, False, False)
    a = [m(0, [0, 2]), m(1, [0, 1, 2]), m(2, [0, 3]), m(3, [0, 1, 3])]
    b = [m(0, [0, 2]), m(1, [0, 3]), m(2, [0, 1, 3])]
    cols = "score_id string, part_ord int, is_reference boolean, measures array<struct<m_idx:int,onsets:array<int>,silent:boolean,landmark:boolean,has_key:boolean,has_time:boolean>>"
    d = combine.align_parts(spark.createDataFrame([("s", 0, True, a), ("s", 1, False, b), ("s", 2, False, a)], cols)).orderBy("part_ord", "column").collect()
    assert [r.m_idx for r in d] == [0, 1, 2, 3, 0, None, 1, 2, 0, 1, 2, 3]
    long = combine.align_parts(spark.createDataFrame([("s", 0, True, b), ("s", 1, False, a)], cols))
    assert [r.m_idx for r in long.orderBy("part_ord", "column").collect()] == [0, None, 1, 2, 0, 1, 2, 3]
    assert combine.rejected(long).count() == 0
