"""Further queries on scores: checks, comparison, lookups, exact numbers, models; with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.functions import music, rational, text
from stavework.operators import aggregates, calibration, checks, keys, matching, placement, repairs, sets, state, windows
from stavework.plans.score_queries import _E, _M, _N, _P, _S, _TOK, _V, MEASURE, STAFF, VOICE, events, measures, notes, samples, timed
from stavework.runtime import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


# --- checks


@query(
    f"""WITH {_E}, {_V}, c AS (SELECT score_id, total, count(*) AS n FROM v GROUP BY ALL), x AS (SELECT score_id, total AS expected FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY n DESC, total) AS r FROM c) WHERE r = 1),
    l AS (SELECT score_id, part_ord, staff_no, max(m_idx) AS last FROM e GROUP BY ALL), j AS (SELECT v.*, expected, last, m_idx = 0 AND total < expected AS pickup FROM v JOIN x USING (score_id) JOIN l USING (score_id, part_ord, staff_no)),
    h AS (SELECT score_id, part_ord, staff_no, arg_max(total, voice_no) AS held FROM j WHERE pickup GROUP BY ALL)
    SELECT score_id, part_ord, staff_no, m_idx, voice_no, CAST(expected AS BIGINT) AS expected, CAST(total AS BIGINT) AS actual FROM j LEFT JOIN h USING (score_id, part_ord, staff_no)
    WHERE total <> expected AND NOT pickup AND NOT (m_idx = last AND coalesce(held, 0) <> 0 AND total + coalesce(held, 0) = expected)"""
)
def rhythm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: voices that don't fill the time in force, pickups aside; each score states its usual length at the start, and may begin with a pickup."""
    v = checks.voice_lengths(timed(spark, sf_dir))
    usual = aggregates.bounded_mode(v, ["score_id"], "total", 0, 2**62, "expected")
    m = v.select(*MEASURE).distinct().join(usual, "score_id").withColumn("measure_ticks", F.when(F.col("m_idx") == F.lit(0), F.col("expected"))).drop("expected")
    first = m.groupBy(*STAFF).agg(F.min("m_idx").alias("__f"))
    # staves that begin later state it at their first measure
    m = m.join(first, STAFF).join(usual, "score_id").withColumn("measure_ticks", F.when(F.col("m_idx") == F.col("__f"), F.col("expected"))).drop("expected", "__f")
    m = m.withColumn("m_number", F.col("m_idx").cast("string")).withColumn("implicit", F.lit(False))
    return checks.rhythm_check(m, v).select(*VOICE, "expected", "actual")


@query(
    f"""WITH {_E}, m AS (SELECT score_id, part_ord, staff_no, m_idx, arg_max(kind, event_no) AS bar FROM e GROUP BY ALL), n AS (SELECT score_id, part_ord, staff_no, count(*) AS n FROM m GROUP BY ALL),
    u AS (SELECT score_id FROM n GROUP BY 1 HAVING min(n) <> max(n)), r AS (SELECT score_id, min(part_ord * 1000 + staff_no) AS ref FROM m GROUP BY 1), b AS (SELECT m.score_id, m_idx, bar AS first_bar FROM m JOIN r ON m.score_id = r.score_id AND part_ord * 1000 + staff_no = ref)
    SELECT score_id, 'measure-count' AS kind, CAST(NULL AS INT) AS part_ord, CAST(NULL AS INT) AS staff_no, CAST(NULL AS INT) AS m_idx FROM u
    UNION ALL SELECT m.score_id, 'barline', part_ord, staff_no, m.m_idx FROM m JOIN b ON m.score_id = b.score_id AND m.m_idx = b.m_idx JOIN r ON r.score_id = m.score_id WHERE part_ord * 1000 + staff_no <> ref AND bar IS DISTINCT FROM first_bar"""
)
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uneven staves, and measures that end otherwise than the first staff's; the last event stands for the barline."""
    m = events(spark, sf_dir, *MEASURE, "kind").groupBy(*MEASURE).agg(F.max_by("kind", "event_no").alias("right_barline"))
    return checks.alignment_check(m).select("score_id", "kind", "part_ord", "staff_no", "m_idx")


@query(f"WITH {_M}, i AS (SELECT DISTINCT score_id FROM m WHERE len(issues) > 0) SELECT DISTINCT m.score_id, i.score_id IS NULL AS passed FROM m LEFT JOIN i ON m.score_id = i.score_id")
def report_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in which no check found anything."""
    m = measures(spark, sf_dir, "score_id", "issues")
    return checks.passed(m.select("score_id", F.explode("issues").alias("i")), m)


@query(
    f"""WITH {_M}, l AS (SELECT ly_file, ly_line, max(measure_no) AS found FROM m WHERE ly_file IS NOT NULL AND ly_line IS NOT NULL GROUP BY ALL), d AS (SELECT measure_no, ly_file, ly_line + 1 AS ly_line FROM m WHERE len(issues) > 0)
    SELECT measure_no, found FROM d LEFT JOIN l ON d.ly_file = l.ly_file AND d.ly_line = l.ly_line"""
)
def located_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure that the line below each measure with issues stands for."""
    m = measures(spark, sf_dir, "ly_file", "ly_line", "issues")
    d = m.filter(F.size("issues") > 0).select("measure_no", "ly_file", (F.col("ly_line") + 1).alias("ly_line"))
    return checks.located(d, m, "ly_file", "ly_line", "measure_no").select("measure_no", "found")


# --- comparison


@query(f"WITH {_E}, s AS (SELECT score_id, part_ord, staff_no, count(*) AS n FROM e GROUP BY ALL), a AS (SELECT * FROM s WHERE part_ord = 0), b AS (SELECT * FROM s WHERE part_ord = 1) SELECT coalesce(a.score_id, b.score_id) AS score_id, coalesce(a.staff_no, b.staff_no) AS staff_no, a.n AS a, b.n AS b FROM a FULL JOIN b ON a.score_id = b.score_id AND a.staff_no = b.staff_no")
def staves_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staves of two parts paired for scoring."""
    s = events(spark, sf_dir, *STAFF).groupBy(*STAFF).agg(F.count(F.lit(1)).alias("n"))
    return matching.by_ordinal(s.filter("part_ord = 0"), s.filter("part_ord = 1"), ["score_id"], "staff_no", "n")


@query(
    f"""WITH {_E}, a AS (SELECT score_id, {_TOK} AS t, count(*) AS k FROM e WHERE staff_no = 1 GROUP BY ALL), b AS (SELECT score_id, {_TOK} AS t, count(*) AS k FROM e WHERE staff_no = 2 GROUP BY ALL),
    o AS (SELECT score_id, sum(coalesce(a.k, 0)) AS x, sum(coalesce(b.k, 0)) AS y, sum(least(coalesce(a.k, 0), coalesce(b.k, 0))) AS z FROM a FULL JOIN b USING (score_id, t) GROUP BY ALL),
    p AS (SELECT score_id, CASE WHEN x = 0 THEN 0 ELSE z / CAST(x AS DOUBLE) END AS p, CASE WHEN y = 0 THEN 0 ELSE z / CAST(y AS DOUBLE) END AS r FROM o)
    SELECT score_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p"""
)
def rhythm_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the rhythm of the upper staves against the lower ones'."""
    t = timed(spark, sf_dir).withColumn("t", F.concat_ws(":", "offset_ticks", "duration_ticks"))
    o = aggregates.bag_overlap(t.filter("staff_no = 1"), t.filter("staff_no = 2"), ["score_id"], "t")
    p, r, f = aggregates.precision_recall(F.col("n_both"), F.col("n_a"), F.col("n_b"))
    return o.select("score_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


@query(f"WITH {_E}, a AS (SELECT DISTINCT score_id, part_ord, m_idx FROM e WHERE staff_no = 1), b AS (SELECT DISTINCT score_id, part_ord, m_idx FROM e WHERE staff_no = 2) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.score_id = a.score_id AND b.part_ord = a.part_ord AND b.m_idx = a.m_idx)")
def only_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures that only a part's first staff has."""
    e, keys = events(spark, sf_dir, *MEASURE), ["score_id", "part_ord", "m_idx"]
    one, two = (e.filter(F.col("staff_no") == n).select(*keys).distinct() for n in (1, 2))
    return sets.only_in(one, two, keys)


# --- order


@query(
    f"""WITH {_E}, c AS (SELECT *, CASE WHEN kind = 'chord' THEN event_no END AS own FROM e), w AS (SELECT event_no, kind, last_value(own IGNORE NULLS) OVER (PARTITION BY score_id, part_ord, staff_no ORDER BY m_idx, t0, CASE WHEN kind = 'chord' THEN 0 ELSE 1 END, event_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sign FROM c)
    SELECT event_no, sign FROM w WHERE kind <> 'chord'"""
)
def sign_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign active at each event, the last at or before its place in any measure; chord symbols stand for clefs."""
    t = timed(spark, sf_dir, "kind")
    signs = t.filter("kind = 'chord'").groupBy(*STAFF, "m_idx", "offset_ticks").agg(F.max("event_no").alias("clef"))
    others = t.filter("kind <> 'chord'").select(*STAFF, "m_idx", "offset_ticks", "event_no")
    return windows.clef_in_force(signs, others, STAFF).select("event_no", F.col("clef").alias("sign"))


@query(f"WITH {_E} SELECT event_no, first_value(CASE WHEN NOT grace THEN event_no END IGNORE NULLS) OVER (PARTITION BY score_id, part_ord, staff_no, m_idx, voice_no ORDER BY ev_ord, event_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS main FROM e")
def grace_mains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's next event that is no grace note, itself included."""
    e = events(spark, sf_dir, *VOICE, "ev_ord", "grace")
    return windows.with_next_plain(e, VOICE, ["ev_ord", "event_no"], "grace", "event_no", "main").select("event_no", "main")


@query(f"WITH {_E}, d AS (SELECT DISTINCT score_id, part_ord, staff_no, m_idx, voice_no FROM e) SELECT *, dense_rank() OVER (PARTITION BY score_id, part_ord, staff_no, m_idx ORDER BY voice_no) AS new_verse FROM d")
def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voices of each measure numbered anew, as verses of a system are."""
    return repairs.renumber_verses(events(spark, sf_dir, *VOICE).select(*VOICE).distinct(), MEASURE, "voice_no")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY length(payload) DESC NULLS LAST, received_at, payload) AS k FROM raw_review) SELECT record_id, length(payload) AS size FROM r WHERE k = 1")
def longest_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each record the run with the highest score, the first of equals; the payload's length is the score."""
    r = load(spark, sf_dir, "raw_review").select("record_id", "received_at", F.length("payload").cast("bigint").alias("size"))
    return state.best_candidate(r, ["record_id"], "size", "received_at").select("record_id", "size")


# --- exact numbers, pitches, names


@query(
    """WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_no ORDER BY loaded_at DESC) AS rn FROM score_event) WHERE rn = 1),
    s AS (SELECT event_no, onset.num * duration.den + duration.num * onset.den AS n, onset.den * duration.den AS d FROM e WHERE onset IS NOT NULL AND duration IS NOT NULL)
    SELECT event_no, n // gcd(n, d) AS num, d // gcd(n, d) AS den FROM s"""
)
def exact_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ends of events as reduced fractions."""
    e = events(spark, sf_dir, "onset", "duration").filter("onset IS NOT NULL AND duration IS NOT NULL")
    return e.select("event_no", rational.add(F.col("onset"), F.col("duration")).alias("s")).select("event_no", "s.num", "s.den")


@query(f"WITH {_E}, {_N} SELECT CAST(34 - (7 * n.pitch.octave + instr('CDEFGAB', n.pitch.step) - 1) AS INT) AS treble, CAST(22 - (7 * n.pitch.octave + instr('CDEFGAB', n.pitch.step) - 1) AS INT) AS bass, count(*) AS n FROM n GROUP BY ALL")
def staff_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far below the middle line notes lie, under a treble and a bass clef."""
    step = lambda sign, line: music.staff_step(F.lit(sign), F.lit(line), F.lit(0), F.col("step"), F.col("octave"))
    return notes(spark, sf_dir).select(step("G", 2).alias("treble"), step("F", 4).alias("bass")).groupBy("treble", "bass").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_E}, {_N}, o AS (SELECT CASE part_ord % 3 WHEN 0 THEN 0 WHEN 1 THEN -2 ELSE 3 END AS shift, CASE part_ord % 3 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 2 END AS st, 7 * n.pitch.octave + instr('CDEFGAB', n.pitch.step) - 1 AS d, {_P} AS midi FROM n),
    k AS (SELECT shift, substr('CDEFGAB', CAST((d + st) % 7 AS INT) + 1, 1) AS step, CAST((d + st) // 7 AS INT) AS octave, midi + shift AS midi FROM o),
    a AS (SELECT shift, step, octave, midi - 12 * (octave + 1) - CASE step WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 END AS alter FROM k)
    SELECT shift, step, CAST(alter AS INT) AS alter, octave, count(*) AS n FROM a WHERE shift = 0 OR abs(alter) <= 2 GROUP BY ALL"""
)
def concert_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounding pitches; every third part is taken to stand in B flat, every third in E flat."""
    n = notes(spark, sf_dir, "part_ord").withColumn("shift", F.when(F.col("part_ord") % 3 == 1, -2).when(F.col("part_ord") % 3 == 2, 3).otherwise(0))
    t = n.select("shift", music.concert(F.col("step"), F.col("alter"), F.col("octave"), F.col("shift")).alias("t")).filter("t IS NOT NULL")
    return t.groupBy("shift", "t.step", "t.alter", "t.octave").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT work) AS n FROM openscore WHERE regexp_matches(work, '[\\p{L}\\p{N}]')")
def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """works that are left as words once the marks behind them are gone; the lookbehind has no equal in SQL, so their number is checked."""
    o = load(spark, sf_dir, "openscore").select(F.col("work").alias("words")).filter("work IS NOT NULL").distinct()
    s = o.select(text.clean_continuation(F.concat("words", F.lit(" . . . "), "words", F.lit(" ---"))).alias("s")).filter("s IS NOT NULL AND NOT s RLIKE '[.]{3}'")
    return s.agg(F.count(F.lit(1)).alias("n"))


# --- models, merged statistics


_WEIGHTS = [((k * 7) % 11 - 5) / 20 for k in range(23)]
_POINTS = [(0.1, 0.05), (0.4, 0.3), (0.4, 0.35), (0.9, 0.95)]


@query(
    f"""WITH {_S}, z AS (SELECT sample_no, 0.1 + {' + '.join(f'({w}) * x[{k + 1}]' for k, w in enumerate(_WEIGHTS))} AS z FROM s WHERE len(x) = 23 AND len(list_filter(x, lambda v: v IS NULL OR isnan(v))) = 0),
    p AS (SELECT sample_no, 1 / (1 + exp(-greatest(least(z, 30), -30))) AS p FROM z)
    SELECT sample_no, round(CASE WHEN p <= 0.1 THEN 0.05 WHEN p <= 0.4 THEN 0.05 + (p - 0.1) / 0.3 * 0.25 WHEN p <= 0.9 THEN 0.35 + (p - 0.4) / 0.5 * 0.6 ELSE 0.95 END, 6) AS confidence FROM p"""
)
def applied_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model given by its numbers applied to every sample."""
    s = samples(spark, sf_dir).filter((F.size("x") == 23) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    return s.select("sample_no", F.round(calibration.apply_model(F.col("x"), (_WEIGHTS, 0.1, _POINTS)), 6).alias("confidence"))


@query(
    f"""WITH {_E}, p AS (SELECT score_id, part_ord, count(*) AS n_events, count(*) FILTER (kind = 'rest') AS n_rests FROM e GROUP BY ALL), k AS (SELECT score_id, kind, min(event_no) AS o FROM e WHERE kind IS NOT NULL GROUP BY ALL), l AS (SELECT score_id, list(kind ORDER BY o) AS kinds FROM k GROUP BY 1)
    SELECT score_id, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(n_rests) AS BIGINT) AS n_rests, coalesce(any_value(kinds), []) AS kinds FROM p LEFT JOIN l USING (score_id) GROUP BY score_id"""
)
def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, U4: the statistics of parts added up for their score, with the kinds in the order in which they are first seen."""
    e = events(spark, sf_dir, "score_id", "part_ord", "kind")
    parts = e.groupBy("score_id", "part_ord").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("kind") == "rest").alias("n_rests"))
    return aggregates.merged_stats(parts, ["score_id"], ["n_events", "n_rests"], aggregates.first_seen(e, ["score_id"], "kind", "event_no", "kinds"))


@query(f"WITH {_M}, k AS (SELECT DISTINCT score_id, unnest(issues).kind AS kind FROM m) SELECT score_id, list(kind ORDER BY kind) AS kinds FROM k WHERE kind IS NOT NULL GROUP BY score_id")
def issue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of issues of each score, sorted."""
    i = measures(spark, sf_dir, "score_id", "issues").select("score_id", F.explode("issues.kind").alias("kind")).filter("kind IS NOT NULL")
    return aggregates.sorted_distinct(i, ["score_id"], "kind", "kinds")


@query(
    f"""WITH {_E}, g AS (SELECT *, CASE WHEN NOT isnan(confidence) THEN confidence END AS g FROM e), s AS (SELECT score_id, avg(g) AS m, avg(CASE WHEN bbox IS NOT NULL THEN 1.0 ELSE 0.0 END) AS l FROM g GROUP BY 1), t AS (SELECT score_id, part_ord, staff_no, avg(g) AS m FROM g GROUP BY ALL)
    SELECT event_no, CASE WHEN g IS NULL THEN 1.0 ELSE 0.0 END AS no_grade, CASE WHEN coalesce(g, 0) < 0.8 THEN 1.0 ELSE 0.0 END AS below, CASE WHEN kind = 'rest' THEN 1.0 ELSE 0.0 END AS rest,
    round(coalesce(min(g) OVER (PARTITION BY g.score_id, g.part_ord, g.staff_no, m_idx), 0), 6) AS measure_min, round(coalesce(t.m, s.m, 0) + 1e-9, 6) AS staff_mean, round(coalesce(s.m, 0) + 1e-9, 6) AS score_mean, round(l + 1e-9, 6) AS located
    FROM g JOIN s ON g.score_id = s.score_id JOIN t ON g.score_id = t.score_id AND g.part_ord = t.part_ord AND g.staff_no = t.staff_no"""
)
def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every event; those of four grains are shown."""
    t = timed(spark, sf_dir, "kind", "tuplet", "notes", "confidence", "bbox")
    t = t.filter("score_id IS NOT NULL AND part_ord IS NOT NULL AND staff_no IS NOT NULL").select("event_no", *VOICE, "kind", "grace", "tuplet", F.when(~F.isnan("confidence"), F.col("confidence")).alias("grade"), F.col("bbox").isNotNull().alias("located"), F.lit(True).alias("fills"), F.lit(4.0).alias("length"), F.size("notes").alias("n_notes"), *[F.lit(False).alias(c) for c in ("rhythm_repaired", "clef_repaired", "out_of_range", "altered")])
    x = lambda name: F.col("x")[calibration.FEATURES.index(name)]
    f = calibration.features(t)
    return f.select("event_no", x("no_grade").alias("no_grade"), x("grade_below_0_8").alias("below"), x("rest").alias("rest"), F.round(x("measure_min_grade"), 6).alias("measure_min"), F.round(x("staff_mean_grade") + 1e-9, 6).alias("staff_mean"), F.round(x("score_mean_grade") + 1e-9, 6).alias("score_mean"), F.round(x("score_located") + 1e-9, 6).alias("located"))


# --- keys and places


_KEYS = "CASE WHEN len(issues) > 0 THEN len(issues) % 3 END"


@query(
    f"""WITH {_M}, k AS (SELECT measure_no, score_id, lower(trim(part)) AS part, staff, m_idx, {_KEYS} AS fifths, m_idx % 32 = 0 AS new_piece, m_idx % 4 = 0 AS at_system, m_idx % 8 = 0 AS double_bar FROM m),
    f AS (SELECT *, coalesce(last_value(fifths IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS key, coalesce(last_value(fifths IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER w = 1 AS head FROM k WINDOW w AS (PARTITION BY score_id, part, staff ORDER BY m_idx, measure_no)),
    c AS (SELECT *, coalesce(fifths <> before, false) AS changed, new_piece OR head AS piece FROM f)
    SELECT measure_no, CAST(key AS BIGINT) AS key, CAST(sum(CASE WHEN piece OR changed AND (NOT at_system OR double_bar) THEN 1 ELSE 0 END) OVER w AS BIGINT) AS stretch, CAST(sum(CASE WHEN piece OR changed OR at_system THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment
    FROM c WINDOW w AS (PARTITION BY score_id, part, staff ORDER BY m_idx, measure_no ROWS UNBOUNDED PRECEDING)"""
)
def key_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of runs; the number of issues stands for the key read, every fourth measure begins a system."""
    m = measures(spark, sf_dir, "score_id", "part", "staff", "m_idx", "issues").withColumn("part", F.lower(F.trim("part")))
    every = lambda n: F.col("m_idx") % n == 0
    m = m.select("measure_no", "score_id", "part", "staff", "m_idx", F.when(F.size("issues") > 0, F.size("issues") % 3).cast("bigint").alias("fifths"), every(32).alias("new_piece"), every(4).alias("at_system"), every(8).alias("double_bar"))
    return keys.stretches(m, ["score_id", "part", "staff"], ["m_idx", "measure_no"]).select("measure_no", "key", "stretch", "segment")


@query(
    f"""WITH {_E}, r AS (SELECT score_id, part_ord, m_idx, max(dots) AS v FROM e GROUP BY ALL), n AS (SELECT score_id, m_idx, v, count(*) AS k, min(part_ord) AS f FROM r GROUP BY ALL),
    o AS (SELECT *, sum(k) OVER (PARTITION BY score_id, m_idx) AS a, row_number() OVER (PARTITION BY score_id, m_idx ORDER BY k DESC, f) AS r FROM n), j AS (SELECT score_id, m_idx, CASE WHEN a >= 2 AND k * 2 > a THEN v END AS maj FROM o WHERE r = 1),
    t AS (SELECT *, row_number() OVER w > 1 AND maj IS DISTINCT FROM lag(maj) OVER w AS turn FROM j WINDOW w AS (PARTITION BY score_id ORDER BY m_idx)),
    d AS (SELECT r.*, t.maj, t.turn, coalesce(u.turn, false) AS after, coalesce(r.v <> t.maj, false) AS differs FROM r JOIN t ON r.score_id = t.score_id AND r.m_idx = t.m_idx LEFT JOIN t u ON u.score_id = r.score_id AND u.m_idx = r.m_idx + 1),
    b AS (SELECT *, CASE WHEN differs AND NOT coalesce(lag(differs) OVER w AND lag(maj) OVER w = maj, false) THEN 1 ELSE 0 END AS fresh FROM d WINDOW w AS (PARTITION BY score_id, part_ord ORDER BY m_idx)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY score_id, part_ord ORDER BY m_idx ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT score_id, part_ord, min(m_idx) AS first, max(m_idx) AS last, any_value(maj) AS majority FROM g WHERE differs GROUP BY score_id, part_ord, run HAVING NOT arg_min(turn, m_idx) AND NOT arg_max(after, m_idx)"""
)
def differing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of measures in which a part differs from the others; the most dots of a measure stand for the key."""
    r = events(spark, sf_dir, "score_id", "part_ord", "m_idx", "dots").groupBy("score_id", "part_ord", "m_idx").agg(F.max("dots").alias("v"))
    j = aggregates.majority(r, ["score_id", "m_idx"], "v", "part_ord")
    return keys.differing_runs(r, j, "score_id", "part_ord", "m_idx", "v")


@query(
    f"""WITH {_M}, s AS (SELECT score_id, bbox.page AS page, bbox.x AS x, max(bbox.w) AS w FROM m WHERE bbox IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY page, x) - 1 AS ordinal FROM s)
    SELECT measure_no, o.page AS page, round(o.x, 4) AS x, round(o.w, 4) AS w FROM m LEFT JOIN o ON m.score_id = o.score_id AND m.m_idx = o.ordinal"""
)
def placed_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each measure on the stack of its number; the distinct places of boxes are the stacks."""
    m = measures(spark, sf_dir, "score_id", "m_idx", "bbox")
    s = m.filter("bbox IS NOT NULL").groupBy("score_id", F.col("bbox.page").alias("page"), F.col("bbox.x").alias("x")).agg(F.max("bbox.w").alias("w"))
    s = placement.number_stacks(s, "score_id", ["page", "x"])
    return placement.place_measures(m, s, "score_id", "m_idx").select("measure_no", "stack.page", F.round("stack.x", 4).alias("x"), F.round("stack.w", 4).alias("w"))


@query(f"WITH {_E}, {_M}, w AS (SELECT DISTINCT score_id, staff_no FROM e), p AS (SELECT DISTINCT score_id, CAST(staff AS INT) AS staff_no FROM m WHERE bbox IS NOT NULL) SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.score_id = w.score_id AND p.staff_no = w.staff_no)")
def unmapped_staves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staves of scores that no box on the page stands for."""
    w = events(spark, sf_dir, "score_id", "staff_no").select("score_id", "staff_no").distinct()
    p = measures(spark, sf_dir, "score_id", "staff", "bbox").filter("bbox IS NOT NULL").select("score_id", F.col("staff").cast("int").alias("staff_no")).distinct()
    return placement.place_staves(w, p, ["score_id", "staff_no"])[1]
