"""MusicXML files as flat event and measure rows.

Document order matters (a cursor moves with notes, backups and forwards), which Spark's XML reader loses: files are read
whole with ``binaryFile`` and parsed with ElementTree in Arrow batches, one file a row. Files are small; a folder of
millions is spread by Spark's file splits.
"""

from __future__ import annotations

import io
import math
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAC = "struct<num:bigint,den:bigint>"
BAR = "struct<style:string,repeat:string,ending:string,ending_type:string>"
SCHEMA = f"""
score_id string, error string, title string, composer string,
part array<struct<part_ord:int,part_id:string,name:string,abbreviation:string,transpose_semitones:int>>,
measure array<struct<part_ord:int,staff_no:int,m_idx:int,m_number:string,implicit:boolean,added:boolean,
  key:struct<fifths:int,mode:string>,time:struct<beats:int,beat_type:int,symbol:string>,left_barline:{BAR},right_barline:{BAR},
  clefs:array<struct<sign:string,line:int,octave_change:int,offset:{FRAC}>>>>,
event array<struct<part_ord:int,staff_no:int,m_idx:int,voice_no:int,ev_ord:int,kind:string,onset:{FRAC},duration:{FRAC},
  offset_ticks:bigint,duration_ticks:bigint,note_type:string,dots:int,tuplet:struct<actual:int,normal:int>,grace:boolean,measure_rest:boolean,
  notes:array<struct<pitch:struct<step:string,alter:int,octave:int>,tie_start:boolean,tie_stop:boolean,accidental_shown:boolean>>,
  lyrics:array<struct<text:string,verse:int,syllabic:string,extend:boolean>>,articulations:array<string>>>,
chord array<struct<part_ord:int,staff_no:int,m_idx:int,ord:int,onset:{FRAC},root:string,kind:string,bass:string,text:string>>,
ticks_per_quarter bigint
"""


def container(data: bytes) -> bytes:
    """The score within a compressed file: the one the container names, else the first XML outside META-INF; other bytes as they are."""
    if not data.startswith(b"PK"):
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if "META-INF/container.xml" in names:
            root = ET.fromstring(z.read("META-INF/container.xml"))
            named = [e.get("full-path") for e in root.iter() if e.tag.rpartition("}")[2] == "rootfile"]
            if named and named[0] in names:
                return z.read(named[0])
        return z.read(next(n for n in names if not n.startswith("META-INF/") and n.lower().endswith((".xml", ".musicxml"))))


def _int(e: ET.Element | None, path: str, default: int | None = None) -> int | None:
    t = e.findtext(path) if e is not None else None
    try:
        return int(float(t)) if t is not None and t.strip() else default
    except ValueError:
        return default


def _q(x: Fraction) -> dict:
    return {"num": x.numerator, "den": x.denominator}


def _barline(b: ET.Element) -> dict:
    r, e = b.find("repeat"), b.find("ending")
    return {"style": (b.findtext("bar-style") or "regular").strip(), "repeat": r.get("direction") if r is not None else None, "ending": e.get("number") if e is not None else None, "ending_type": e.get("type") if e is not None else None}


class _Part:
    """One part's rows, filled measure by measure."""

    def __init__(self, ordinal: int):
        self.ord = ordinal
        self.divisions, self.staves, self.transpose = 1, 1, 0
        self.measures: list[dict] = []
        self.events: list[dict] = []
        self.chords: list[dict] = []
        self.length: Fraction | None = None

    def attributes(self, a: ET.Element, rows: dict[int, dict], at: Fraction) -> None:
        self.divisions = _int(a, "divisions", self.divisions) or self.divisions
        self.staves = max(self.staves, _int(a, "staves", 1) or 1)
        for s in range(1, self.staves + 1):
            rows.setdefault(s, {"key": None, "time": None, "clefs": []})
        t = a.find("transpose")
        if t is not None:
            self.transpose = (_int(t, "chromatic", 0) or 0) + 12 * (_int(t, "octave-change", 0) or 0)

        def staves(e: ET.Element) -> list[int]:
            return [int(e.get("number"))] if e.get("number") else list(range(1, self.staves + 1))

        for k in a.findall("key"):
            if k.find("fifths") is not None:
                for s in staves(k):
                    rows.setdefault(s, {"key": None, "time": None, "clefs": []})["key"] = {"fifths": max(-7, min(7, _int(k, "fifths", 0) or 0)), "mode": k.findtext("mode")}
        for t in a.findall("time"):
            beats = sum(int(x) for x in re.findall(r"\d+", t.findtext("beats") or "")) or 4
            kind = _int(t, "beat-type", 4) or 4
            self.length = Fraction(4 * beats, kind)
            for s in staves(t):
                rows.setdefault(s, {"key": None, "time": None, "clefs": []})["time"] = {"beats": beats, "beat_type": kind, "symbol": t.get("symbol") or "normal"}
        for c in a.findall("clef"):
            s = int(c.get("number") or 1)
            sign = (c.findtext("sign") or "G").strip()
            rows.setdefault(s, {"key": None, "time": None, "clefs": []})["clefs"].append({"sign": sign, "line": _int(c, "line"), "octave_change": _int(c, "clef-octave-change", 0), "offset": _q(at)})

    def measure(self, m: ET.Element, index: int) -> int:
        """Adds one measure; gives the number of rest measures a multi-measure rest here stands for, 1 for none."""
        rows: dict[int, dict] = {s: {"key": None, "time": None, "clefs": []} for s in range(1, self.staves + 1)}
        left = right = None
        at = last = Fraction(0)
        many, events, open_event = 1, [], None
        for e in m:
            tag = e.tag.rpartition("}")[2]
            if tag == "attributes":
                self.attributes(e, rows, at)
                many = max(many, _int(e, "measure-style/multiple-rest", 1) or 1)
            elif tag in ("backup", "forward"):
                d = Fraction(_int(e, "duration", 0) or 0, self.divisions)
                at = max(Fraction(0), at - d) if tag == "backup" else at + d
            elif tag == "barline":
                if e.get("location") == "left":
                    left = _barline(e)
                elif e.get("location", "right") == "right":
                    right = _barline(e)
            elif tag == "harmony":
                root = e.find("root")
                if root is not None:
                    name = lambda x, p: (x.findtext(f"{p}-step") or "").strip() + {1: "#", -1: "b", 2: "##", -2: "bb"}.get(_int(x, f"{p}-alter", 0) or 0, "")
                    bass, kind = e.find("bass"), e.find("kind")
                    where = at + Fraction(_int(e, "offset", 0) or 0, self.divisions)
                    self.chords.append({"part_ord": self.ord, "staff_no": _int(e, "staff", 1), "m_idx": index, "ord": len(self.chords), "onset": _q(where), "root": name(root, "root"), "kind": (kind.text or "").strip() if kind is not None else None, "bass": name(bass, "bass") if bass is not None else None, "text": kind.get("text") if kind is not None else None})
            elif tag == "note":
                grace = e.find("grace") is not None
                d = Fraction(0) if grace else Fraction(_int(e, "duration", 0) or 0, self.divisions)
                if e.find("chord") is not None and open_event is not None:
                    self._head(e, open_event)
                    open_event["kind"] = "chord"
                    continue
                rest = e.find("rest")
                tm = e.find("time-modification")
                open_event = {
                    "part_ord": self.ord, "staff_no": _int(e, "staff", 1), "m_idx": index, "voice_no": _int(e, "voice", 1), "ev_ord": len(events), "kind": "rest" if rest is not None else "note", "onset": at, "duration": d,
                    "note_type": e.findtext("type"), "dots": len(e.findall("dot")), "tuplet": {"actual": _int(tm, "actual-notes", 1), "normal": _int(tm, "normal-notes", 1)} if tm is not None else None, "grace": grace,
                    "measure_rest": rest is not None and (rest.get("measure") == "yes" or (e.find("type") is None and self.length is not None and d == self.length)),
                    "notes": [], "lyrics": [{"text": "".join(t.text or "" for t in y.findall("text")), "verse": int(re.sub(r"\D", "", y.get("number") or "") or 1), "syllabic": y.findtext("syllabic") or "single", "extend": y.find("extend") is not None} for y in e.findall("lyric")],
                    "articulations": sorted({x.tag.rpartition("}")[2] for a in e.findall("notations/articulations") for x in a} | ({"fermata"} if e.find("notations/fermata") is not None else set())),
                }
                if rest is None:
                    self._head(e, open_event)
                events.append(open_event)
                last = at
                at = max(at, last + d)
        number = m.get("number") or ""
        for s in range(1, max([self.staves, *rows, *(v["staff_no"] for v in events)]) + 1):
            r = rows.get(s, {"key": None, "time": None, "clefs": []})
            self.measures.append({"part_ord": self.ord, "staff_no": s, "m_idx": index, "m_number": number, "implicit": m.get("implicit") == "yes", "added": False, **r, "left_barline": left, "right_barline": right})
        # by onset, grace notes first, then as in the file
        events.sort(key=lambda v: (v["staff_no"], v["voice_no"], v["onset"], not v["grace"], v["ev_ord"]))
        for k, v in enumerate(events):
            v["ev_ord"] = k
        self.events.extend(events)
        return many

    @staticmethod
    def _head(e: ET.Element, event: dict) -> None:
        p = e.find("pitch")
        if p is not None:
            ties = {t.get("type") for t in e.findall("tie")}
            event["notes"].append({"pitch": {"step": (p.findtext("step") or "").strip(), "alter": _int(p, "alter", 0), "octave": _int(p, "octave", 4)}, "tie_start": "start" in ties, "tie_stop": "stop" in ties, "accidental_shown": e.find("accidental") is not None})


def _rest_only(m: ET.Element) -> bool:
    notes = m.findall("note")
    return bool(notes) and all(n.find("rest") is not None for n in notes)


def parse(data: bytes) -> dict:
    """The rows of one file, by table. Raises ValueError for what is no partwise score."""
    try:
        root = ET.fromstring(container(data))
    except (ET.ParseError, zipfile.BadZipFile, StopIteration) as e:
        raise ValueError(f"no MusicXML: {e}") from e
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else e.tag
    if root.tag != "score-partwise":
        raise ValueError(f"not a partwise score: {root.tag}")
    out: dict = {"title": root.findtext("work/work-title") or root.findtext("movement-title"), "composer": next((c.text for c in root.findall("identification/creator") if c.get("type") == "composer"), None), "part": [], "measure": [], "event": [], "chord": []}
    names = {p.get("id"): p for p in root.findall("part-list/score-part")}
    for k, part in enumerate(root.findall("part")):
        x, index, written = _Part(k), 0, part.findall("measure")
        for j, m in enumerate(written):
            many = x.measure(m, index)
            index += 1
            following = sum(1 for f in written[j + 1 : j + many] if _rest_only(f))
            if many > 1 and following < many - 1:  # the file writes the rest once: add the others
                for _ in range(many - 1):
                    for s in range(1, x.staves + 1):
                        x.measures.append({"part_ord": k, "staff_no": s, "m_idx": index, "m_number": str(index + 1), "implicit": False, "added": True, "key": None, "time": None, "clefs": [], "left_barline": None, "right_barline": None})
                        x.events.append({"part_ord": k, "staff_no": s, "m_idx": index, "voice_no": 1, "ev_ord": 0, "kind": "rest", "onset": Fraction(0), "duration": x.length or Fraction(4), "note_type": None, "dots": 0, "tuplet": None, "grace": False, "measure_rest": True, "notes": [], "lyrics": [], "articulations": []})
                    index += 1
        n = names.get(part.get("id"))
        out["part"].append({"part_ord": k, "part_id": part.get("id"), "name": n.findtext("part-name") if n is not None else None, "abbreviation": n.findtext("part-abbreviation") if n is not None else None, "transpose_semitones": x.transpose or None})
        out["measure"] += x.measures
        out["event"] += x.events
        out["chord"] += x.chords
    # six times the least common multiple also holds triplet and dotted repairs
    grid = 6 * math.lcm(1, *(f.denominator for e in out["event"] for f in (e["onset"], e["duration"])))
    for e in out["event"]:
        e["offset_ticks"], e["duration_ticks"] = int(e["onset"] * grid), int(e["duration"] * grid)
        e["onset"], e["duration"] = _q(e["onset"]), _q(e["duration"])
    out["ticks_per_quarter"] = grid
    return out


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """One nested row a file, named by its path without folder and suffix; an unreadable file has ``error`` and no rows, one without a byte no row.

    ``tables`` flattens it. Whole files, any number; a folder or glob of .xml, .musicxml and .mxl.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                row = {"score_id": re.sub(r"\.(xml|musicxml|mxl)$", "", p.rpartition("/")[2]), "error": None, "title": None, "composer": None, "part": [], "measure": [], "event": [], "chord": [], "ticks_per_quarter": None}
                try:
                    row.update(parse(bytes(data)))
                except ValueError as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def table(scores: DataFrame, name: str) -> DataFrame:
    """``part``, ``measure``, ``event`` or ``chord`` rows with their score_id; measures also have ``measure_ticks`` where a time is stated."""
    d = scores.select("score_id", "ticks_per_quarter", F.explode(name).alias("r")).select("score_id", "ticks_per_quarter", "r.*")
    if name == "measure":
        d = d.withColumn("measure_ticks", F.when(F.col("time").isNotNull(), F.call_function("div", F.col("time.beats") * 4 * F.col("ticks_per_quarter"), F.col("time.beat_type").cast("bigint"))))
    return d


def written_index(measures: DataFrame, keys: list[str]) -> DataFrame:
    """The running index of written measures; added rests share the index before them."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("m_idx").rowsBetween(Window.unboundedPreceding, 0)
    return measures.withColumn("written", F.greatest(F.sum((~F.col("added")).cast("int")).over(w) - 1, F.lit(0)))
