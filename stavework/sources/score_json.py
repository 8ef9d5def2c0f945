"""The strict JSON form of scores: unknown or missing fields and values out of range are errors, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PITCH = "struct<step:string,alter:int,octave:int>"
EVENT = f"struct<kind:string,offset:string,duration:string,notes:array<struct<pitch:{PITCH},tie_start:boolean,tie_stop:boolean,accidental_shown:boolean>>,note_type:string,dots:int,tuplet:array<int>,grace:boolean,measure_rest:boolean,lyrics:array<struct<text:string,verse:int,syllabic:string,extend:boolean>>,articulations:array<string>,confidence:double,bbox:struct<page:int,x:double,y:double,w:double,h:double>>"
MEASURE = f"struct<index:int,number:string,key:struct<fifths:int,mode:string>,time:struct<beats:int,beat_type:int,symbol:string>,voices:array<struct<number:int,events:array<{EVENT}>>>,implicit:boolean,bbox:struct<page:int,x:double,y:double,w:double,h:double>,confidence:double>"
SCORE = f"struct<title:string,composer:string,parts:array<struct<id:string,name:string,abbreviation:string,transpose_semitones:int,staves:array<struct<number:int,measures:array<{MEASURE}>>>>>,source:string>"
#: The fields a score, a part and a pitch may have.
FIELDS = {"$": ("title", "composer", "parts", "source", "provenance")}


def read_json(df: DataFrame, text: str) -> DataFrame:
    """Adds ``score`` and ``error``; one of them is null. Texts that don't parse, unknown fields at the top, and
    values out of range (kind, step, alter within 2, fifths within 7) are errors."""
    d = df.withColumn("score", F.from_json(text, SCORE, {"mode": "PERMISSIVE"})).withColumn("__keys", F.expr(f"json_object_keys({text})"))
    parts = F.col("score.parts")
    measures = F.flatten(F.transform(parts, lambda p: F.flatten(F.transform(p["staves"], lambda s: s["measures"]))))
    voices = F.flatten(F.transform(measures, lambda m: F.coalesce(m["voices"], F.array())))
    evs = F.flatten(F.transform(voices, lambda v: F.coalesce(v["events"], F.array())))
    heads = F.flatten(F.transform(evs, lambda e: F.coalesce(e["notes"], F.array())))
    bad = lambda ok: F.coalesce(~ok, F.lit(False))
    error = (
        F.when(F.col("__keys").isNull(), "no JSON object")
        .when(F.size(F.array_except("__keys", F.array(*map(F.lit, FIELDS["$"])))) > 0, "unknown field")
        .when(parts.isNull(), "parts missing")
        .when(bad(F.forall(evs, lambda e: e["kind"].isin("note", "rest", "chord"))), "kind")
        .when(bad(F.forall(heads, lambda h: h["pitch"]["step"].isin(*"CDEFGAB") & (F.abs(h["pitch"]["alter"]) <= 2))), "pitch")
        .when(bad(F.forall(measures, lambda m: F.coalesce(F.abs(m["key"]["fifths"]) <= 7, F.lit(True)))), "key")
    )
    return d.withColumn("error", error).withColumn("score", F.when(F.col("error").isNull(), F.col("score"))).drop("__keys")


def json_events(scores: DataFrame, score_id: str) -> DataFrame:
    """The events of parsed scores as flat rows; onsets stay text (``7/3``), ``rational.parse`` reads them."""
    p = scores.filter("error IS NULL").select(score_id, F.posexplode("score.parts").alias("part_ord", "p"))
    s = p.select(score_id, "part_ord", F.explode("p.staves").alias("s"))
    m = s.select(score_id, "part_ord", F.col("s.number").alias("staff_no"), F.explode("s.measures").alias("m"))
    v = m.select(score_id, "part_ord", "staff_no", F.col("m.index").alias("m_idx"), F.explode("m.voices").alias("v"))
    return v.select(score_id, "part_ord", "staff_no", "m_idx", F.col("v.number").alias("voice_no"), F.posexplode("v.events").alias("ev_ord", "e")).select(score_id, "part_ord", "staff_no", "m_idx", "voice_no", "ev_ord", "e.*")


def to_json(column: Column) -> Column:
    """the JSON of a struct with its nulls written."""
    return F.to_json(column, {"ignoreNullFields": "false"})
