"""Queries on scores, measures, events and calibration samples, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stavework.functions import labels, music, rational, text
from stavework.operators import aggregates, calibration, checks, engraving, matching, repairs, sets, state, windows
from stavework.runtime import join_by_key, latest, load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


TICKS = 60480
STAFF = ["score_id", "part_ord", "staff_no"]
MEASURE = [*STAFF, "m_idx"]
VOICE = [*MEASURE, "voice_no"]
#: The rows that count: of each key the latest delivery.
_E = "e AS (SELECT *, onset.num * 60480 // onset.den AS t0, duration.num * 60480 // duration.den AS td FROM (SELECT *, row_number() OVER (PARTITION BY event_no ORDER BY loaded_at DESC) AS rn FROM score_event) WHERE rn = 1)"
_M = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY measure_no ORDER BY loaded_at DESC) AS rn FROM review_measure) WHERE rn = 1)"
_S = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_no ORDER BY sample_no) AS rn FROM samples) WHERE rn = 1)"


def measures(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    m = load(spark, sf_dir, "review_measure").select("measure_no", "loaded_at", *columns)
    return latest(m, "measure_no", "loaded_at")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    e = load(spark, sf_dir, "score_event").select("event_no", "loaded_at", *columns)
    return latest(e, "event_no", "loaded_at").drop("loaded_at")


def timed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with offset_ticks and duration_ticks."""
    e = events(spark, sf_dir, *VOICE, "ev_ord", "grace", "onset", "duration", *columns)
    return e.withColumn("offset_ticks", rational.ticks(F.col("onset"))).withColumn("duration_ticks", rational.ticks(F.col("duration"))).drop("onset", "duration")


def notes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    e = events(spark, sf_dir, "notes", *columns)
    return e.select("event_no", *columns, F.posexplode("notes").alias("head", "n")).select("event_no", *columns, "head", "n.pitch.step", F.col("n.pitch.alter_by").cast("int").alias("alter"), F.col("n.pitch.octave").cast("int").alias("octave"), "n.tie_start", "n.tie_stop")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(load(spark, sf_dir, "samples").filter("sample_no IS NOT NULL"), "sample_no")


_MIDI = "12 * (CAST({p}.octave AS INT) + 1) + CASE {p}.step WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 END + coalesce(CAST({p}.alter_by AS INT), 0)"
_P = _MIDI.format(p="n.pitch")
_N = "n AS (SELECT e.*, unnest(notes) AS n FROM e)"
_LABEL = "n.pitch.step || CASE WHEN coalesce(n.pitch.alter_by, 0) >= 0 THEN repeat('#', CAST(coalesce(n.pitch.alter_by, 0) AS BIGINT)) ELSE repeat('b', CAST(-n.pitch.alter_by AS BIGINT)) END || CAST(CAST(n.pitch.octave AS INT) AS VARCHAR)"

# --- review and ranking


@query(f"WITH {_M} SELECT measure_no, score_id, CAST(len(issues) AS INT) AS n_issues, priority FROM m WHERE len(issues) > 0 AND priority IS NOT NULL")
def review_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: measures that have issues, by priority and place."""
    m = measures(spark, sf_dir, "score_id", "m_idx", "staff", "part", "priority", "issues")
    m = m.select("measure_no", "score_id", "m_idx", "part", "staff", "priority", F.size("issues").alias("n_issues"))
    m = m.filter((F.col("n_issues") > 0) & F.col("priority").isNotNull())
    return m.orderBy(F.desc("priority"), "m_idx", "part", "staff", "measure_no").select("measure_no", "score_id", "n_issues", "priority")


_WEIGHT = "CASE i.kind WHEN 'compile' THEN 5.0 WHEN 'bar-check' THEN 3.0 WHEN 'rhythm' THEN 3.0 WHEN 'range' THEN 2.0 WHEN 'repaired' THEN 1.0 ELSE 0.0 END"


@query(
    f"""WITH {_M}, i AS (SELECT measure_no, unnest(issues) AS i FROM m), k AS (SELECT measure_no, sum({_WEIGHT}) AS w FROM i GROUP BY 1),
    v AS (SELECT measure_no, unnest(events).confidence AS c FROM m), l AS (SELECT measure_no, count(*) FILTER (c < 0.5) AS low, min(c) AS lo FROM v WHERE c IS NOT NULL GROUP BY 1)
    SELECT measure_no, round(CAST(coalesce(w, 0) + coalesce(low, 0) + coalesce(1 - lo, 0) AS DOUBLE) + 1e-9, 4) AS computed FROM m LEFT JOIN k USING (measure_no) LEFT JOIN l USING (measure_no)"""
)
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card N: priorities from issues and confidences."""
    m = measures(spark, sf_dir, "issues", "events")
    p = checks.review(F.coalesce(F.col("issues.kind"), F.array()), F.coalesce(F.col("events.confidence"), F.array()))
    return m.select("measure_no", F.round(p + 1e-9, 4).alias("computed"))


@query(f"WITH {_M}, i AS (SELECT unnest(issues).kind AS kind, measure_no FROM m) SELECT kind, count(*) AS n, count(DISTINCT measure_no) AS n_measures FROM i GROUP BY kind")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27."""
    i = measures(spark, sf_dir, "issues").select("measure_no", F.explode("issues").alias("i"))
    return i.groupBy("i.kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("measure_no").alias("n_measures"))


@query(f"WITH {_M}, i AS (SELECT measure_no, unnest(issues) AS i FROM m) SELECT i.kind AS kind, i.detail AS detail, row_number() OVER (PARTITION BY i.kind, i.detail ORDER BY measure_no) AS place, measure_no FROM i")
def issues_by_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal issues with the measures that have them, numbered in order; one row each, as an issue may be in a third of all."""
    i = measures(spark, sf_dir, "issues").select("measure_no", F.explode("issues").alias("i")).select("measure_no", "i.kind", "i.detail")
    return aggregates.numbered_in_order(i, ["kind", "detail"], "measure_no", "place")


@query(f"WITH {_M} SELECT measure_no, coalesce(nullif(m_number, ''), CAST(m_idx + 1 AS VARCHAR)) AS label FROM m")
def measure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    return measures(spark, sf_dir, "m_number", "m_idx").select("measure_no", checks.measure_label(F.col("m_number"), F.col("m_idx")).alias("label"))


@query(f"WITH {_M} SELECT measure_no, score_id, loaded_at FROM m ORDER BY loaded_at DESC, measure_no DESC LIMIT 50")
def newest_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the newest, of equals the later row first."""
    return state.newest(measures(spark, sf_dir, "score_id"), "loaded_at", "measure_no", 50).select("measure_no", "score_id", "loaded_at")


# --- pitches


@query(f"WITH {_E}, {_N} SELECT {_LABEL} AS label, {_P} AS midi, CAST(7 * n.pitch.octave + instr('CDEFGAB', n.pitch.step) - 1 AS INT) AS diatonic, count(*) AS n FROM n GROUP BY ALL")
def pitch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 to P5."""
    p = (F.col("step"), F.col("alter"), F.col("octave"))
    n = notes(spark, sf_dir)
    return n.select(music.label(*p).alias("label"), music.midi(*p).alias("midi"), music.diatonic(p[0], p[2]).alias("diatonic")).groupBy("label", "midi", "diatonic").agg(F.count(F.lit(1)).alias("n"))


def _case(rules: tuple, column: str) -> str:
    quoted = "'{}'".format
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(coalesce(part_name, ''))), '{r[0]}') THEN {quoted(r[0]) if column == 'rule' else r[1] if column == 'lo' else r[2]}" for r in rules) + f" ELSE {quoted(text.DEFAULT_RANGE[0]) if column == 'rule' else text.DEFAULT_RANGE[1] if column == 'lo' else text.DEFAULT_RANGE[2]} END"


@query(f"WITH {_E}, {_N}, r AS (SELECT event_no, {_P} AS midi, {_case(text.RANGES, 'rule')} AS rule, {_case(text.RANGES, 'lo')} AS lo, {_case(text.RANGES, 'hi')} AS hi FROM n) SELECT event_no, midi, rule, lo, hi FROM r WHERE midi < lo OR midi > hi")
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes outside their part's range."""
    n = notes(spark, sf_dir, "part_name").withColumn("abbreviation", F.lit(None).cast("string"))
    names = load(spark, sf_dir, "score_event").select("part_name", F.lit(None).cast("string").alias("abbreviation"))
    return checks.range_check(n, names).select("event_no", "midi", "rule", "lo", "hi")


@query(
    f"""WITH {_E}, {_N}, o AS (SELECT n.pitch AS p, 7 * n.pitch.octave + instr('CDEFGAB', n.pitch.step) - 1 + 1 AS d, {_P} + 2 AS midi FROM n),
    k AS (SELECT substr('CDEFGAB', CAST(d % 7 AS INT) + 1, 1) AS step, CAST(d // 7 AS INT) AS octave, midi FROM o),
    a AS (SELECT step, octave, midi - 12 * (octave + 1) - CASE step WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 END AS alter FROM k)
    SELECT step, CAST(alter AS INT) AS alter, octave, count(*) AS n FROM a WHERE abs(alter) <= 2 GROUP BY ALL"""
)
def transposed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes a major second up."""
    n = notes(spark, sf_dir).withColumn("i", music.parse_interval(F.lit("M2")))
    t = n.select(music.transpose(F.col("step"), F.col("alter"), F.col("octave"), F.col("i.steps"), F.col("i.semitones")).alias("t")).filter("t IS NOT NULL")
    return t.groupBy("t.step", "t.alter", "t.octave").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_E}, {_N} SELECT score_id, part_ord, median({_P}) AS median_midi, median({_P}) < 60 AS lower_staff FROM n GROUP BY ALL")
def median_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, card L: the exact median pitch of each part, and the staff it goes to in a reduction."""
    n = notes(spark, sf_dir, "score_id", "part_ord")
    m = n.groupBy("score_id", "part_ord").agg(F.median(music.midi(F.col("step"), F.col("alter"), F.col("octave"))).alias("median_midi"))
    return m.withColumn("lower_staff", F.col("median_midi") < 60)


@query(f"WITH {_E}, {_N}, c AS (SELECT score_id, part_ord, {_P} AS v, count(*) AS k FROM n WHERE {_P} BETWEEN 48 AND 84 GROUP BY ALL) SELECT score_id, part_ord, v AS mode_midi FROM (SELECT *, row_number() OVER (PARTITION BY score_id, part_ord ORDER BY k DESC, v) AS r FROM c) WHERE r = 1")
def common_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest of the most frequent pitches between two bounds."""
    n = notes(spark, sf_dir, "score_id", "part_ord").withColumn("midi", music.midi(F.col("step"), F.col("alter"), F.col("octave")))
    return aggregates.bounded_mode(n, ["score_id", "part_ord"], "midi", 48, 84, "mode_midi")


@query(f"WITH {_E}, {_N}, h AS (SELECT event_no, {_P} AS midi, n.tie_start AS a, n.tie_stop AS b FROM n) SELECT event_no, midi, bool_or(a) AS tie_start, bool_or(b) AS tie_stop, count(*) AS n_heads FROM h GROUP BY event_no, midi HAVING count(*) > 1")
def unisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of one chord that share a pitch, merged."""
    n = notes(spark, sf_dir).withColumn("midi", music.midi(F.col("step"), F.col("alter"), F.col("octave"))).withColumn("confidence", F.lit(None).cast("double"))
    return sets.merge_unisons(n, ["event_no"]).filter("n_heads > 1").drop("confidence")


# --- durations and onsets


_V = "v AS (SELECT score_id, part_ord, staff_no, m_idx, voice_no, coalesce(sum(td) FILTER (NOT grace), 0) AS total, greatest(coalesce(max(t0 + td) FILTER (NOT grace), 0), 0) AS end_tick FROM e GROUP BY ALL)"


@query(f"WITH {_E}, {_V} SELECT score_id, part_ord, staff_no, m_idx, voice_no, CAST(total AS BIGINT) AS total, CAST(end_tick AS BIGINT) AS end_tick FROM v")
def voice_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3."""
    return checks.voice_lengths(timed(spark, sf_dir)).withColumnRenamed("end", "end_tick")


@query(
    f"""WITH {_E}, {_V}, c AS (SELECT score_id, total, count(*) AS n FROM v GROUP BY ALL), x AS (SELECT score_id, total AS expected FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY n DESC, total) AS r FROM c) WHERE r = 1)
    SELECT v.score_id, part_ord, staff_no, m_idx, voice_no, CAST(expected AS BIGINT) AS expected, CAST(total AS BIGINT) AS actual FROM v JOIN x USING (score_id) WHERE total <> expected"""
)
def fill_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4's shape where no time is stated: voices that differ from their score's usual length."""
    v = checks.voice_lengths(timed(spark, sf_dir))
    usual = aggregates.bounded_mode(v, ["score_id"], "total", 0, 2**62, "expected")
    return v.join(usual, "score_id").filter("total <> expected").select(*VOICE, "expected", F.col("total").alias("actual"))


@query(f"WITH {_E}, {_V} SELECT score_id, m_idx, CAST(max(end_tick) AS BIGINT) AS grid FROM v GROUP BY ALL")
def measure_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the longest voice of each measure over all staves."""
    return checks.voice_lengths(timed(spark, sf_dir)).groupBy("score_id", "m_idx").agg(F.max("end").alias("grid"))


@query(
    f"""WITH {_E}, p AS (SELECT *, lag(t0 + td) OVER (PARTITION BY score_id, part_ord, staff_no, m_idx, voice_no ORDER BY ev_ord, event_no) AS before FROM e WHERE NOT grace)
    SELECT score_id, part_ord, staff_no, m_idx, voice_no, bool_and(coalesce(before = t0, true)) AS is_sequential FROM p GROUP BY ALL"""
)
def sequential_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices whose every onset is the end of the event before."""
    return windows.sequential(timed(spark, sf_dir).filter("NOT grace"), VOICE, ["ev_ord", "event_no"], "offset_ticks", "duration_ticks")


@query(f"WITH {_E} SELECT event_no, CAST(coalesce(sum(CASE WHEN grace THEN 0 ELSE td END) OVER (PARTITION BY score_id, part_ord, staff_no, m_idx, voice_no ORDER BY ev_ord, event_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS relaid FROM e")
def relaid_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets laid end to end."""
    t = timed(spark, sf_dir).withColumn("d", F.when(F.col("grace"), 0).otherwise(F.col("duration_ticks")))
    return windows.relay(t, VOICE, ["ev_ord", "event_no"], "d", "relaid").select("event_no", "relaid")


@query(
    f"""WITH {_E}, p AS (SELECT *, coalesce(max(t0 + td) OVER (PARTITION BY score_id, part_ord, staff_no, m_idx, voice_no ORDER BY ev_ord, event_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM e WHERE NOT grace)
    SELECT event_no, CAST(cursor AS BIGINT) AS gap_from, CAST(t0 AS BIGINT) AS gap_to FROM p WHERE t0 > cursor"""
)
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: where skips go: events that begin after all before them in their voice ended."""
    w = Window.partitionBy(*VOICE).orderBy("ev_ord", "event_no").rowsBetween(Window.unboundedPreceding, -1)
    t = timed(spark, sf_dir).filter("NOT grace").withColumn("gap_from", F.coalesce(F.max(F.col("offset_ticks") + F.col("duration_ticks")).over(w), F.lit(0)))
    return t.filter("offset_ticks > gap_from").select("event_no", "gap_from", F.col("offset_ticks").alias("gap_to"))


@query(
    f"""WITH {_E}, p AS (SELECT event_no, td, lead(td, 1) OVER w AS b, lead(td, 2) OVER w AS c FROM e WHERE NOT grace AND dots = 0 AND tuplet IS NULL AND kind <> 'rest' WINDOW w AS (PARTITION BY score_id, part_ord, staff_no, m_idx, voice_no ORDER BY ev_ord, event_no))
    SELECT event_no, CAST(td AS BIGINT) AS duration_ticks FROM p WHERE td = b AND td = c"""
)
def triplet_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three plain notes of one value in a row."""
    t = timed(spark, sf_dir, "dots", "tuplet", "kind").filter("NOT grace AND dots = 0 AND tuplet IS NULL AND kind <> 'rest'")
    return windows.equal_triples(t, VOICE, ["ev_ord", "event_no"], "duration_ticks").select("event_no", "duration_ticks")


@query(f"WITH {_E}, g AS (SELECT score_id, part_ord, staff_no, m_idx, voice_no, grace, count(*) FILTER (NOT grace) OVER (PARTITION BY score_id, part_ord, staff_no, m_idx, voice_no ORDER BY ev_ord, event_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS plain FROM e), v AS (SELECT score_id, m_idx, count(*) AS n FROM g WHERE grace AND plain = 0 GROUP BY score_id, part_ord, staff_no, m_idx, voice_no) SELECT score_id, m_idx, max(n) AS lead FROM v GROUP BY ALL")
def grace_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the longest run of grace notes that opens a voice, of each measure."""
    w = Window.partitionBy(*VOICE).orderBy("ev_ord", "event_no").rowsBetween(Window.unboundedPreceding, 0)
    e = events(spark, sf_dir, *VOICE, "ev_ord", "grace").withColumn("plain", F.count(F.when(~F.col("grace"), 1)).over(w))
    return e.filter("grace AND plain = 0").groupBy(*VOICE).agg(F.count(F.lit(1)).alias("n")).groupBy("score_id", "m_idx").agg(F.max("n").alias("lead"))


@query(
    f"""WITH {_E}, b AS (SELECT *, (NOT grace AND kind <> 'rest' AND td < 60480) AS short, t0 // 60480 AS beat FROM e),
    p AS (SELECT *, coalesce(lag(short AND true) OVER w AND short AND lag(beat) OVER w = beat, false) AS joined FROM b WINDOW w AS (PARTITION BY score_id, part_ord, staff_no, m_idx, voice_no ORDER BY ev_ord, event_no)),
    r AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY score_id, part_ord, staff_no, m_idx, voice_no ORDER BY ev_ord, event_no ROWS UNBOUNDED PRECEDING) AS run FROM p)
    SELECT score_id, part_ord, staff_no, m_idx, voice_no, min(event_no) AS first_event, count(*) AS n FROM r WHERE short GROUP BY score_id, part_ord, staff_no, m_idx, voice_no, run HAVING count(*) > 1"""
)
def beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: runs of notes shorter than a quarter within one beat."""
    t = timed(spark, sf_dir, "kind").withColumn("short", ~F.col("grace") & (F.col("kind") != "rest") & (F.col("duration_ticks") < TICKS)).withColumn("beat", F.floor(F.col("offset_ticks") / TICKS))
    order = ["ev_ord", "event_no"]
    joined = windows.previous("short", VOICE, order) & F.col("short") & (windows.previous("beat", VOICE, order) == F.col("beat"))
    r = windows.runs(t.withColumn("starts", ~F.coalesce(joined, F.lit(False))), VOICE, order, "starts", "run")
    return r.filter("short").groupBy(*VOICE, "run").agg(F.min("event_no").alias("first_event"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("run")


# --- in force, runs and turns


@query(f"WITH {_M} SELECT measure_no, last_value(min_confidence IGNORE NULLS) OVER (PARTITION BY score_id, lower(trim(part)), staff ORDER BY m_idx, measure_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_force FROM m")
def value_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stated value up to each measure."""
    m = measures(spark, sf_dir, "score_id", "part", "staff", "m_idx", "min_confidence").withColumn("part", F.lower(F.trim("part")))
    return windows.in_force(m, ["score_id", "part", "staff"], ["m_idx", "measure_no"], "min_confidence", "in_force").select("measure_no", "in_force")


@query(
    f"""WITH {_M}, p AS (SELECT *, last_value(bbox IGNORE NULLS) OVER (PARTITION BY score_id, lower(trim(part)), staff ORDER BY m_idx, measure_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m),
    f AS (SELECT *, CASE WHEN bbox.page <> b.page OR bbox.x < b.x THEN 1 ELSE 0 END AS fresh FROM p)
    SELECT measure_no, CAST(sum(fresh) OVER (PARTITION BY score_id, lower(trim(part)), staff ORDER BY m_idx, measure_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS system FROM f"""
)
def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the page by measure boxes."""
    m = measures(spark, sf_dir, "score_id", "part", "staff", "m_idx", "bbox").withColumn("part", F.lower(F.trim("part")))
    return windows.systems(m, ["score_id", "part", "staff"], ["m_idx", "measure_no"]).select("measure_no", "system")


@query(
    f"""WITH {_M}, p AS (SELECT *, lag(bbox) OVER w AS b, row_number() OVER w AS k FROM m WINDOW w AS (PARTITION BY score_id, lower(trim(part)), staff ORDER BY m_idx, measure_no)),
    f AS (SELECT *, CASE WHEN k > 1 AND (bbox IS NULL OR b IS NULL OR coalesce(bbox.page <> b.page OR abs(bbox.y - b.y) > greatest(b.h, 1) / 2, true)) THEN 1 ELSE 0 END AS fresh FROM p)
    SELECT measure_no, CAST(sum(fresh) OVER (PARTITION BY score_id, lower(trim(part)), staff ORDER BY m_idx, measure_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS system FROM f"""
)
def systems_by_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other rule."""
    m = measures(spark, sf_dir, "score_id", "part", "staff", "m_idx", "bbox").withColumn("part", F.lower(F.trim("part")))
    return windows.systems_by_height(m, ["score_id", "part", "staff"], ["m_idx", "measure_no"]).select("measure_no", "system")


@query(f"WITH {_M}, p AS (SELECT *, lag(part_name) OVER w AS b, row_number() OVER w AS k FROM m WINDOW w AS (PARTITION BY score_id, lower(trim(part)), staff ORDER BY m_idx, measure_no)) SELECT measure_no, part_name FROM p WHERE k > 1 AND part_name IS DISTINCT FROM b")
def name_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures at which the part's name changes, null being a name."""
    m = measures(spark, sf_dir, "score_id", "part", "staff", "m_idx", "part_name").withColumn("part", F.lower(F.trim("part")))
    return windows.turns(m, ["score_id", "part", "staff"], ["m_idx", "measure_no"], "part_name").select("measure_no", "part_name")


@query(
    f"""WITH {_M}, p AS (SELECT measure_no, part_name, last_value(part_name IGNORE NULLS) OVER (PARTITION BY score_id, lower(trim(part)), staff ORDER BY m_idx, measure_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m)
    SELECT measure_no, CASE WHEN part_name IS DISTINCT FROM b THEN part_name END AS stated FROM p"""
)
def restated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names kept only where they change."""
    m = measures(spark, sf_dir, "score_id", "part", "staff", "m_idx", "part_name").withColumn("part", F.lower(F.trim("part")))
    return windows.drop_restated(m, ["score_id", "part", "staff"], ["m_idx", "measure_no"], "part_name").select("measure_no", F.col("part_name").alias("stated"))


@query(
    f"""WITH {_M}, r AS (SELECT score_id, lower(trim(part)) AS part, m_idx AS a, m_idx + len(issues) AS b FROM m WHERE len(issues) > 0),
    p AS (SELECT *, max(b) OVER (PARTITION BY score_id, part ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    g AS (SELECT *, sum(CASE WHEN coalesce(a > reach, true) THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, part ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM p)
    SELECT score_id, part, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY score_id, part, run"""
)
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of measures touched by issues, united."""
    m = measures(spark, sf_dir, "score_id", "part", "m_idx", "issues").filter(F.size("issues") > 0)
    r = m.select("score_id", F.lower(F.trim("part")).alias("part"), F.col("m_idx").alias("a"), (F.col("m_idx") + F.size("issues")).alias("b"))
    return windows.merge_ranges(r, ["score_id", "part"], "a", "b")


# --- votes, shares, overlaps


@query(f"WITH {_M}, n AS (SELECT score_id, lower(trim(part_name)) AS v, count(*) AS k FROM m WHERE part_name IS NOT NULL GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY score_id ORDER BY k DESC) AS r FROM n) SELECT score_id, CASE WHEN count(*) = 1 THEN min(v) END AS winner FROM r WHERE r = 1 GROUP BY score_id")
def name_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent part name of each score, null if drawn."""
    m = measures(spark, sf_dir, "score_id", "part_name").withColumn("v", F.lower(F.trim("part_name")))
    return aggregates.vote(m, ["score_id"], "v")


@query(
    f"""WITH {_M}, n AS (SELECT score_id, m_idx, priority AS v, count(*) AS k, min(measure_no) AS f FROM m GROUP BY ALL),
    r AS (SELECT *, sum(k) OVER (PARTITION BY score_id, m_idx) AS a, row_number() OVER (PARTITION BY score_id, m_idx ORDER BY k DESC, f) AS r FROM n)
    SELECT score_id, m_idx, CASE WHEN a >= 2 AND k * 2 > a THEN v END AS majority FROM r WHERE r = 1"""
)
def column_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict majority of each measure column."""
    return aggregates.majority(measures(spark, sf_dir, "score_id", "m_idx", "priority"), ["score_id", "m_idx"], "priority", "measure_no")


@query(
    f"""WITH {_E}, p AS (SELECT score_id, part_ord, max(m_idx) + 1 AS l, avg(confidence) FILTER (NOT isnan(confidence)) AS c FROM e GROUP BY ALL),
    s AS (SELECT score_id, max(l) AS shared FROM (SELECT score_id, l FROM p GROUP BY ALL HAVING count(*) > 1) GROUP BY score_id),
    o AS (SELECT score_id, list(l ORDER BY l) AS ls FROM p GROUP BY score_id),
    d AS (SELECT p.* FROM p JOIN o USING (score_id) LEFT JOIN s USING (score_id) WHERE l = coalesce(shared, ls[len(ls) // 2 + 1]))
    SELECT score_id, part_ord, l AS n_measures FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY round(coalesce(c, 0), 9) DESC, part_ord) AS r FROM d) WHERE r = 1"""
)
def reference_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part others would be aligned to."""
    c = F.round(F.avg(F.when(~F.isnan("confidence"), F.col("confidence"))), 9)
    p = events(spark, sf_dir, "score_id", "part_ord", "m_idx", "confidence").groupBy("score_id", "part_ord").agg((F.max("m_idx") + 1).alias("n_measures"), c.alias("c"))
    return aggregates.reference_part(p, ["score_id"], "part_ord", "n_measures", "c")


@query(
    f"""WITH {_E}, {_V}, g AS (SELECT score_id, m_idx, max(end_tick) AS l FROM v GROUP BY ALL), f AS (SELECT v.*, (end_tick = l) AS fills FROM v JOIN g USING (score_id, m_idx)),
    w AS (SELECT *, sum(CAST(fills AS INT)) OVER (PARTITION BY score_id, m_idx) AS s, count(*) OVER (PARTITION BY score_id, m_idx) AS n FROM f)
    SELECT score_id, part_ord, staff_no, m_idx, voice_no, round(CASE WHEN n = 1 THEN 1.0 ELSE (s - CAST(fills AS INT)) / CAST(n - 1 AS DOUBLE) END, 6) AS others FROM w"""
)
def others_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the other voices of a measure column that fill it."""
    v = checks.voice_lengths(timed(spark, sf_dir))
    v = v.withColumn("fills", F.col("end") == F.max("end").over(Window.partitionBy("score_id", "m_idx")))
    return aggregates.others_share(v, ["score_id", "m_idx"], "fills", "others").select(*VOICE, F.round("others", 6).alias("others"))


_TOK = "CAST(t0 AS VARCHAR) || ':' || CAST(td AS VARCHAR)"


@query(
    f"""WITH {_E}, a AS (SELECT score_id, m_idx, {_TOK} AS t, count(*) AS k FROM e WHERE staff_no = 1 GROUP BY ALL), b AS (SELECT score_id, m_idx, {_TOK} AS t, count(*) AS k FROM e WHERE staff_no = 2 GROUP BY ALL)
    SELECT score_id, m_idx, CAST(sum(coalesce(a.k, 0)) AS BIGINT) AS n_a, CAST(sum(coalesce(b.k, 0)) AS BIGINT) AS n_b, CAST(sum(least(coalesce(a.k, 0), coalesce(b.k, 0))) AS BIGINT) AS n_both FROM a FULL JOIN b USING (score_id, m_idx, t) GROUP BY ALL"""
)
def bag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhythm shared by the upper and the lower staves of a measure, as bags."""
    t = timed(spark, sf_dir).withColumn("t", F.concat_ws(":", "offset_ticks", "duration_ticks"))
    return aggregates.bag_overlap(t.filter("staff_no = 1"), t.filter("staff_no = 2"), ["score_id", "m_idx"], "t")


@query(
    f"""WITH {_E}, t AS (SELECT score_id, m_idx, {_TOK} AS t, count(*) AS have FROM e WHERE staff_no = 1 GROUP BY ALL), p AS (SELECT event_no, score_id, m_idx, {_TOK} AS t, row_number() OVER (PARTITION BY score_id, m_idx, t0, td ORDER BY event_no) AS k FROM e WHERE staff_no = 2)
    SELECT event_no, k <= coalesce(have, 0) AS correct FROM p LEFT JOIN t USING (score_id, m_idx, t)"""
)
def claimed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-staff events that find an equal one, each taken once, in the upper staff."""
    t = timed(spark, sf_dir)
    return aggregates.claimed(t.filter("staff_no = 2"), t.filter("staff_no = 1"), ["score_id", "m_idx"], ["offset_ticks", "duration_ticks"], ["event_no"]).select("event_no", "correct")


@query(f"WITH {_E}, a AS (SELECT score_id, part_ord, m_idx, list_distinct(list(t0) FILTER (staff_no = 1)) AS x, list_distinct(list(t0) FILTER (staff_no = 2)) AS y FROM e GROUP BY ALL) SELECT score_id, part_ord, m_idx, round(len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE), 6) AS jaccard FROM a WHERE len(x) > 0 AND len(y) > 0")
def onset_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared onsets of a part's two staves."""
    t = timed(spark, sf_dir).groupBy("score_id", "part_ord", "m_idx").agg(F.collect_set(F.when(F.col("staff_no") == 1, F.col("offset_ticks"))).alias("x"), F.collect_set(F.when(F.col("staff_no") == 2, F.col("offset_ticks"))).alias("y"))
    return t.filter((F.size("x") > 0) & (F.size("y") > 0)).select("score_id", "part_ord", "m_idx", F.round(sets.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query(f"WITH {_E}, l AS (SELECT score_id, part_ord, staff_no, max(m_idx) AS n FROM e GROUP BY ALL), w AS (SELECT *, max(n) OVER (PARTITION BY score_id) AS most FROM l) SELECT score_id, part_ord, staff_no, CAST(unnest(generate_series(CAST(n AS BIGINT) + 1, CAST(most AS BIGINT))) AS INT) AS m_idx FROM w WHERE n < most")
def missing_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures that staves lack at their end."""
    return sets.missing_measures(events(spark, sf_dir, *MEASURE), STAFF).withColumn("m_idx", F.col("m_idx").cast("int"))


@query(f"WITH {_E} SELECT score_id, count(DISTINCT part_ord) AS n_parts, count(DISTINCT (part_ord, staff_no)) AS n_staves, CAST(max(m_idx) + 1 AS INT) AS n_measures, CAST(sum(len(notes)) AS BIGINT) AS n_notes FROM e GROUP BY score_id")
def score_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    e = events(spark, sf_dir, "score_id", "part_ord", "staff_no", "m_idx", "notes")
    return e.groupBy("score_id").agg(F.countDistinct("part_ord").alias("n_parts"), F.countDistinct("part_ord", "staff_no").alias("n_staves"), (F.max("m_idx") + 1).cast("int").alias("n_measures"), F.sum(F.when(F.col("notes").isNotNull(), F.size("notes"))).alias("n_notes"))


@query(f"WITH {_E} SELECT score_id, round(sum(CASE WHEN NOT isnan(confidence) THEN confidence END) + 1e-9, 4) AS expected_right, count(*) FILTER (confidence < 0.5 AND NOT isnan(confidence)) AS n_low, round(coalesce(avg(CASE WHEN NOT isnan(confidence) THEN confidence END), 0) + 1e-9, 6) AS mean FROM e GROUP BY score_id")
def expected_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A28, A29."""
    c = F.when(~F.isnan("confidence"), F.col("confidence"))
    return events(spark, sf_dir, "score_id", "confidence").groupBy("score_id").agg(F.round(F.sum(c) + 1e-9, 4).alias("expected_right"), F.count_if(c < 0.5).alias("n_low"), F.round(F.coalesce(F.avg(c), F.lit(0.0)) + 1e-9, 6).alias("mean"))


@query(f"WITH {_E} SELECT score_id, part_ord, m_idx, bool_or(kind <> 'rest') AS plays FROM e GROUP BY ALL")
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which measures a part plays."""
    return events(spark, sf_dir, "score_id", "part_ord", "m_idx", "kind").groupBy("score_id", "part_ord", "m_idx").agg(F.bool_or(F.col("kind") != "rest").alias("plays"))


@query(f"WITH {_E}, p AS (SELECT DISTINCT score_id, part_ord, m_idx FROM e WHERE kind <> 'rest'), a AS (SELECT DISTINCT score_id, part_ord FROM p) SELECT x.score_id, x.part_ord AS part_a, y.part_ord AS part_b FROM a x JOIN a y ON x.score_id = y.score_id AND x.part_ord < y.part_ord WHERE NOT EXISTS (SELECT 1 FROM p u JOIN p v ON u.score_id = v.score_id AND u.m_idx = v.m_idx WHERE u.score_id = x.score_id AND u.part_ord = x.part_ord AND v.part_ord = y.part_ord)")
def never_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22."""
    p = events(spark, sf_dir, "score_id", "part_ord", "m_idx", "kind").filter("kind <> 'rest'")
    return matching.never_together(p, "score_id", "part_ord", "m_idx")


@query(f"WITH {_E}, u AS (SELECT score_id, part_ord, staff_no, m_idx, max(m_idx) OVER (PARTITION BY score_id, part_ord, staff_no) AS l FROM e), f AS (SELECT DISTINCT score_id, part_ord, staff_no, l FROM u), k AS (SELECT *, first_value(l) OVER (PARTITION BY score_id ORDER BY part_ord, staff_no) AS ref FROM f) SELECT score_id, part_ord, staff_no, l AS last_idx FROM k WHERE l <> ref")
def uneven_staves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staves whose length differs from the first staff's."""
    l = events(spark, sf_dir, *MEASURE).groupBy(*STAFF).agg(F.max("m_idx").alias("last_idx"))  # noqa: E741
    return matching.differs_from_first(l, ["score_id"], ["part_ord", "staff_no"], "last_idx")


# --- confidence


_BAND = "CASE WHEN p >= 0 AND p < 0.5 THEN '0.0-0.5' WHEN p >= 0.5 AND p < 0.7 THEN '0.5-0.7' WHEN p >= 0.7 AND p < 0.8 THEN '0.7-0.8' WHEN p >= 0.8 AND p < 0.9 THEN '0.8-0.9' WHEN p >= 0.9 AND p < 1.01 THEN '0.9-1.0' END"
_SP = f"{_S}, q AS (SELECT CASE WHEN NOT isnan(grade) THEN grade END AS p, CAST(y AS DOUBLE) AS y FROM s)"


@query(f"WITH {_SP} SELECT {_BAND} AS band, count(*) AS n, round(avg(y) + 1e-9, 6) AS accuracy, round(avg(p) + 1e-9, 6) AS mean_p FROM q GROUP BY 1")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by confidence band."""
    return calibration.by_band(samples(spark, sf_dir), "grade", "y").select("band", "n", F.round(F.col("accuracy") + 1e-9, 6).alias("accuracy"), F.round(F.col("mean_p") + 1e-9, 6).alias("mean_p"))


@query(f"WITH {_SP}, b AS (SELECT {_BAND} AS b, count(*) AS n, avg(y) AS a, avg(p) AS m FROM q WHERE p IS NOT NULL GROUP BY 1) SELECT round(sum(n * abs(a - m)) / sum(n) + 1e-9, 6) AS ece FROM b WHERE b IS NOT NULL")
def band_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    return calibration.band_error(samples(spark, sf_dir), "grade", "y").select(F.round(F.col("ece") + 1e-9, 6).alias("ece"))


@query(f"WITH {_SP}, b AS (SELECT CASE {' '.join(f'WHEN p >= {k / 10} THEN {k}' for k in range(9, -1, -1))} END AS b, count(*) AS n, avg(y) AS a, avg(p) AS m FROM q WHERE p IS NOT NULL GROUP BY 1) SELECT round(sum(n * abs(a - m)) / sum(n) + 1e-9, 6) AS ece FROM b")
def bin_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    return calibration.bin_error(samples(spark, sf_dir), "grade", "y").select(F.round(F.col("ece") + 1e-9, 6).alias("ece"))


@query(f"WITH {_S} SELECT sample_no, CAST((dense_rank() OVER (ORDER BY sample_group NULLS FIRST) - 1) % 4 AS INT) AS fold FROM s")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples dealt into folds by group."""
    return windows.folds(samples(spark, sf_dir).select("sample_no", "sample_group"), "sample_group", 4).select("sample_no", "fold")


@query(f"WITH {_S}, r AS (SELECT sample_no, row_number() OVER (ORDER BY grade, sample_no) - 1 AS r, count(*) OVER () AS n FROM s WHERE grade IS NOT NULL) SELECT sample_no, CAST(r // greatest(1, n // 40) AS BIGINT) AS bin FROM r")
def equal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in order of grade in bins of one size."""
    return windows.equal_bins(samples(spark, sf_dir).filter("grade IS NOT NULL").select("sample_no", "grade"), ["grade", "sample_no"]).select("sample_no", "bin")


@query()
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of samples by models of the other folds; fitted, so no SQL."""
    return calibration.out_of_fold(samples(spark, sf_dir).select("sample_no", "sample_group", "x", "y"), "x", "y", "sample_group").select("sample_no", "fold", "score")


@query()
def isotonic_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the isotonic correction of grades."""
    points = calibration.fit_isotonic(samples(spark, sf_dir), "grade", "y")
    return spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "ord int, p double, q double")


# --- groups and names


_OS = "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_no ORDER BY loaded_at DESC) AS rn FROM openscore) WHERE rn = 1)"


@query(
    f"""WITH {_OS}, g AS (SELECT 'all' AS grp, measures AS v FROM o UNION ALL SELECT 'category:' || lower(trim(category)), measures FROM o WHERE category IS NOT NULL
    UNION ALL SELECT 'source:' || source, measures FROM o WHERE source IS NOT NULL UNION ALL SELECT 'long:yes', measures FROM o WHERE measures >= 16)
    SELECT grp, count(*) AS n, round(avg(v) + 1e-9, 6) AS mean_measures FROM g GROUP BY grp"""
)
def overlapping_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary over groups that overlap, one of them conditional."""
    o = latest(load(spark, sf_dir, "openscore").select("piece_no", "loaded_at", "category", "source", "measures"), "piece_no", "loaded_at")
    groups = {"": F.lit("all"), "category": F.lower(F.trim("category")), "source": F.col("source"), "long": F.when(F.col("measures") >= 16, F.lit("yes"))}
    return aggregates.overlapping_groups(o, groups, [F.count(F.lit(1)).alias("n"), F.round(F.avg("measures") + 1e-9, 6).alias("mean_measures")])


@query(f"WITH {_E}, d AS (SELECT DISTINCT part_name FROM e WHERE part_name IS NOT NULL) SELECT part_name, CASE WHEN regexp_matches(lower(part_name), 'soprano|alto|tenor|baritone|voice|vocal|choir|chorus|\\bbass\\b') THEN false WHEN regexp_matches(lower(part_name), '{text.INSTRUMENTS}') THEN true END AS instrument FROM d")
def instrument_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of voices and of instruments."""
    d = events(spark, sf_dir, "part_name").filter("part_name IS NOT NULL").select("part_name").distinct()
    return d.select("part_name", text.instrument_name(F.col("part_name")).alias("instrument"))


@query("WITH r AS (SELECT record_id, max(received_at) AS received_at, count(*) AS n FROM raw_review GROUP BY 1) SELECT record_id, received_at, CASE WHEN n > 1 THEN 'again' ELSE 'once' END AS status FROM r")
def record_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each record after all its deliveries."""
    r = load(spark, sf_dir, "raw_review").select("record_id", "received_at")
    return r.groupBy("record_id").agg(F.max("received_at").alias("received_at"), F.when(F.count(F.lit(1)) > 1, "again").otherwise("once").alias("status"))


# --- excerpts, names, nearness


@query(
    f"""WITH {_M}, f AS (SELECT *, last_value(min_confidence IGNORE NULLS) OVER (PARTITION BY score_id, lower(trim(part)), staff ORDER BY m_idx, measure_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM m),
    x AS (SELECT *, row_number() OVER (PARTITION BY score_id, lower(trim(part)), staff ORDER BY m_idx, measure_no) - 1 AS i FROM f WHERE TRY_CAST(m_number AS INT) BETWEEN 3 AND 6)
    SELECT measure_no, CAST(i AS INT) AS new_idx, CASE WHEN i = 0 THEN c ELSE min_confidence END AS stated FROM x"""
)
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures printed 3 to 6 of every staff, the first stating what is in force."""
    keys, order = ["score_id", "part", "staff"], ["m_idx", "measure_no"]
    m = measures(spark, sf_dir, *keys, "m_idx", "m_number", "min_confidence").withColumn("part", F.lower(F.trim("part")))
    d = windows.in_force(m, keys, order, "min_confidence", "c").filter(F.expr("try_cast(m_number AS INT)").between(3, 6))
    d = d.withColumn("new_idx", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))
    return d.select("measure_no", "new_idx", F.when(F.col("new_idx") == 0, F.col("c")).otherwise(F.col("min_confidence")).alias("stated"))


@query(
    f"""WITH {_E}, p AS (SELECT score_id, part_ord, min(part_name) AS name FROM e GROUP BY ALL),
    s AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'part') AS g FROM p),
    w AS (SELECT *, count(*) OVER (PARTITION BY score_id, g) AS n, row_number() OVER (PARTITION BY score_id, g ORDER BY part_ord) AS k FROM s)
    SELECT score_id, part_ord, CASE WHEN n > 1 THEN g || '-' || chr(CAST(96 + k AS INT)) ELSE g END AS slug FROM w"""
)
def part_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of parts."""
    p = events(spark, sf_dir, "score_id", "part_ord", "part_name").groupBy("score_id", "part_ord").agg(F.min("part_name").alias("name"))
    return engraving.part_slugs(p, "score_id").select("score_id", "part_ord", "slug")


@query(
    f"""WITH {_E}, c AS (SELECT score_id, part_ord, staff_no, m_idx * 241920 + t0 AS pos, event_no FROM e WHERE kind = 'chord'),
    r AS (SELECT score_id, min(part_ord * 1000 + staff_no) AS s FROM c GROUP BY 1), f AS (SELECT c.* FROM c JOIN r ON c.score_id = r.score_id AND part_ord * 1000 + staff_no = s),
    g AS (SELECT score_id, pos - pos % 1890 AS since, pos, event_no FROM f), l AS (SELECT score_id, since, arg_max(event_no, (pos, event_no)) AS event_no FROM g GROUP BY ALL), n AS (SELECT score_id, max(m_idx + 1) * 241920 AS fin FROM e GROUP BY 1)
    SELECT score_id, CAST(since AS BIGINT) AS since, CAST(coalesce(lead(since) OVER (PARTITION BY score_id ORDER BY since), fin) AS BIGINT) AS until, event_no AS name FROM l JOIN n USING (score_id)"""
)
def chord_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of the first staff with any, on a grid, each until the next."""
    t = timed(spark, sf_dir, "kind")
    pos = (F.col("m_idx").cast("bigint") * 4 * TICKS + F.col("offset_ticks")).alias("pos_ticks")
    c = t.filter("kind = 'chord'").select("score_id", "part_ord", "staff_no", pos, F.col("event_no").alias("name"))
    c = c.groupBy("score_id", "part_ord", "staff_no", "pos_ticks").agg(F.max("name").alias("name"))
    ends = t.groupBy("score_id").agg(((F.max("m_idx") + 1).cast("bigint") * 4 * TICKS).alias("end_ticks"))
    return engraving.chord_spans(c, "score_id", ends, TICKS).withColumnRenamed("at", "since")


@query(f"WITH {_E} SELECT CASE WHEN confidence IS NULL OR isnan(confidence) THEN 'unknown' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS class, count(*) AS n FROM e GROUP BY 1")
def confidence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24, K16."""
    return events(spark, sf_dir, "confidence").groupBy(labels.confidence_class(F.col("confidence")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_SHORT = "|".join(sorted(labels.SHORT_NAMES, key=len, reverse=True))


@query(
    f"""WITH {_E}, d AS (SELECT DISTINCT trim(part_name) AS name FROM e WHERE part_name IS NOT NULL), p AS (SELECT name, lower(regexp_extract(name, '(?i)^\\s*({_SHORT})\\b\\s*(.*)$', 1)) AS base, regexp_extract(name, '(?i)^\\s*({_SHORT})\\b\\s*(.*)$', 2) AS more FROM d)
    SELECT name, CASE WHEN base <> '' THEN rtrim(CASE base {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.SHORT_NAMES.items())} END || ' ' || more) END AS short_name,
    CASE WHEN regexp_matches(lower(name), '{labels.OCTAVE_LOWER}') THEN -12 ELSE 0 END AS shift FROM p"""
)
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names of parts, and how far they sound from what is written."""
    d = events(spark, sf_dir, "part_name").filter("part_name IS NOT NULL").select(F.trim("part_name").alias("name")).distinct()
    none = F.lit(None)
    return d.select("name", labels.short_name(F.col("name")).alias("short_name"), labels.sounding_shift(none.cast("int"), F.col("name"), none.cast("string")).alias("shift"))


@query(
    f"""WITH {_E}, {_M}, l AS (SELECT measure_no, score_id, bbox.page AS page, bbox.x AS x FROM m WHERE bbox IS NOT NULL), r AS (SELECT event_no, score_id, bbox.page AS page, bbox.x AS x FROM e WHERE bbox IS NOT NULL AND kind = 'rest'),
    p AS (SELECT measure_no, event_no, abs(l.x - r.x) AS d FROM l JOIN r ON l.score_id = r.score_id AND l.page = r.page AND abs(l.x - r.x) <= 40), n AS (SELECT *, row_number() OVER (PARTITION BY measure_no ORDER BY d, event_no) AS k FROM p)
    SELECT l.measure_no, event_no, round(d, 4) AS distance FROM l LEFT JOIN n ON l.measure_no = n.measure_no AND k = 1"""
)
def nearest_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To each measure's box the nearest rest of its page, within a distance, the first of equals."""
    l = measures(spark, sf_dir, "score_id", "bbox").filter("bbox IS NOT NULL").select("measure_no", "score_id", "bbox.page", F.col("bbox.x").alias("at"))  # noqa: E741
    r = events(spark, sf_dir, "score_id", "kind", "bbox").filter("bbox IS NOT NULL AND kind = 'rest'").select("event_no", "score_id", "bbox.page", "bbox.x")
    n = matching.nearest(l, r, ["score_id", "page"], "at", "x", 40.0, "event_no", "measure_no")
    return n.select("measure_no", F.col("nearest.event_no").alias("event_no"), F.round("distance", 4).alias("distance"))


@query(
    f"""WITH {_E}, {_M}, p AS (SELECT event_no, score_id, m_idx, bbox.page AS page, bbox.x + bbox.w / 2 AS px, bbox.y + bbox.h / 2 AS py FROM e WHERE bbox IS NOT NULL), b AS (SELECT measure_no, score_id, m_idx, bbox AS b FROM m WHERE bbox IS NOT NULL)
    SELECT event_no, measure_no FROM p JOIN b ON p.score_id = b.score_id AND p.m_idx = b.m_idx AND p.page = b.b.page AND px >= b.x AND px <= b.x + b.w AND py >= b.y AND py <= b.y + b.h"""
)
def events_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose middle lies in a measure's box on the page."""
    c = F.col("bbox")
    p = events(spark, sf_dir, "score_id", "m_idx", "bbox").filter("bbox IS NOT NULL").select("event_no", "score_id", "m_idx", c["page"].alias("page"), (c["x"] + c["w"] / 2).alias("px"), (c["y"] + c["h"] / 2).alias("py"))
    b = measures(spark, sf_dir, "score_id", "m_idx", "bbox").filter("bbox IS NOT NULL").withColumn("page", F.col("bbox.page"))
    return matching.inside(p, b, ["score_id", "m_idx", "page"], "px", "py", "bbox").select("event_no", F.col("box_row.measure_no").alias("measure_no"))


@query(f"WITH {_E}, k AS (SELECT score_id, max(m_idx) + 1 AS n FROM e WHERE part_ord = 0 GROUP BY 1) SELECT e.score_id, event_no, CAST(CASE WHEN part_ord = 0 THEN m_idx ELSE m_idx + coalesce(n, 0) END AS INT) AS m_idx FROM e LEFT JOIN k ON e.score_id = k.score_id")
def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score's other parts set after its first, as a movement is."""
    e = events(spark, sf_dir, "score_id", "part_ord", "m_idx")
    out = sets.append_movement(e.filter("part_ord = 0"), e.filter("part_ord <> 0 OR part_ord IS NULL"))
    return out.select("score_id", "event_no", F.col("m_idx").cast("int").alias("m_idx"))


@query(f"WITH {_E}, {_N}, a AS (SELECT score_id, part_ord, avg({_P}) AS height FROM n GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY height DESC, part_ord) AS k, count(*) OVER (PARTITION BY score_id) AS n FROM (SELECT score_id, part_ord, round(height, 6) AS height FROM a)) SELECT score_id, part_ord, CAST(least(k, 4) AS INT) AS place FROM w WHERE k < 4 OR k = n OR n <= 4")
def loudest_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four parts of a score by height, the lowest always among them."""
    n = notes(spark, sf_dir, "score_id", "part_ord")
    h = n.groupBy("score_id", "part_ord").agg(F.round(F.avg(music.midi(F.col("step"), F.col("alter"), F.col("octave"))), 6).alias("height"))
    return sets.loudest_voices(h, ["score_id"], "height", "part_ord").select("score_id", "part_ord", F.col("place").cast("int").alias("place"))


@query()
def rhythm_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that make voices fill their score's usual length; a search, so no SQL."""
    t = timed(spark, sf_dir, "kind", "dots", "tuplet", "confidence").filter("NOT grace")
    usual = aggregates.bounded_mode(checks.voice_lengths(t), ["score_id"], "total", 1, 2**62, "expected")
    score = t.groupBy("score_id").agg(F.max("m_idx").alias("last_idx"), F.count(F.lit(1)).alias("n"))
    score = score.join(usual, "score_id").withColumnRenamed("score_id", "k_score_id")
    t = join_by_key(t, score, ["score_id"], "n", load(spark, sf_dir, "score_event").count())
    t = t.withColumn("plain", (F.col("kind") != "rest") & (F.col("dots") == 0) & F.col("tuplet").isNull()).withColumn("edge", (F.col("m_idx") == 0) | (F.col("m_idx") == F.col("last_idx")))
    return repairs.rhythm_repairs(t.drop("last_idx", "n"))


@query()
def reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score's parts on two staves."""
    t = timed(spark, sf_dir, "kind", "notes")
    t = t.withColumn("midis", F.transform(F.coalesce("notes", F.array()), lambda n: music.midi(n["pitch"]["step"], n["pitch"]["alter_by"].cast("int"), n["pitch"]["octave"].cast("int")))).drop("notes")
    return repairs.reduction(t)
