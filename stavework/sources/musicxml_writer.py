"""Scores written as MusicXML, one document a score; whole parts are rendered together, scores in parallel."""

from __future__ import annotations

import math
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Written values that take beams, with their number.
BEAMS = {"eighth": 1, "16th": 2, "32nd": 3, "64th": 4, "128th": 5}


def tuplet_marks(events: list[dict]) -> dict[int, str]:
    """K2: ``start`` and ``stop`` by event number: runs of one ratio, closed when they fill a whole number of its values."""
    marks: dict[int, str] = {}
    first, ratio, filled, unit = None, None, 0, 0
    for k, e in enumerate(events):
        t = None if e["tuplet"] is None or e["grace"] else (e["tuplet"]["actual"], e["tuplet"]["normal"])
        if first is not None and t != ratio:
            marks[k - 1] = "stop" if k - 1 != first else "start"
            first = None
        if t is None:
            continue
        if first is None:
            first, ratio, filled, unit = k, t, 0, e["duration_ticks"]
            marks[k] = "start"
        filled += e["duration_ticks"]
        unit = math.gcd(unit, e["duration_ticks"])
        if k != first and unit and filled % (unit * ratio[0]) == 0:
            marks[k] = "stop"
            first = None
    if first is not None and len(events) - 1 != first:
        marks[len(events) - 1] = "stop"
    return marks


def beam_marks(events: list[dict], quarter: int, beats: tuple[int, int] | None) -> dict[int, list[tuple[int, str]]]:
    """K3: (level, begin, continue, end or hook) by event number, for runs of sub-quarter notes within a beat.

    The beat is a quarter, a dotted quarter in compound metres of eighths; rests and longer notes end a run.
    """
    beat = quarter * 3 // 2 if beats and beats[1] == 8 and beats[0] % 3 == 0 and beats[0] > 3 else quarter
    runs: list[list[int]] = []
    for k, e in enumerate(events):
        n = BEAMS.get(e["note_type"] or "", 0)
        if e["grace"]:
            continue
        joins = n and e["kind"] != "rest"
        same = runs and runs[-1] and events[runs[-1][-1]]["offset_ticks"] // beat == e["offset_ticks"] // beat
        if joins and same:
            runs[-1].append(k)
        else:
            runs.append([k] if joins else [])
    out: dict[int, list[tuple[int, str]]] = {}
    for run in runs:
        if len(run) < 2:
            continue
        n = [BEAMS[events[k]["note_type"]] for k in run]
        for level in range(1, max(n) + 1):
            for i, k in enumerate(run):
                if n[i] < level:
                    continue
                left, right = i > 0 and n[i - 1] >= level, i + 1 < len(run) and n[i + 1] >= level
                kind = "continue" if left and right else "begin" if right else "end" if left else "forward hook" if i == 0 else "backward hook"
                out.setdefault(k, []).append((level, kind))
    return out


def render(score: dict) -> str:
    """K1: the document of one score, given as lists of part, measure, event and chord rows with ticks.

    Divisions are the least that hold every onset and duration. Key, time, harmony and barlines are the first staff's, as a
    measure has one of each. Voices keep their number; one used on an earlier staff moves up by 4.
    """
    quarter = score["ticks_per_quarter"] or 1
    step = math.gcd(quarter, *(e[c] for e in score["event"] for c in ("offset_ticks", "duration_ticks")))
    q = lambda t: t // step
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<score-partwise version="4.0">']
    if score.get("title"):
        out.append(f"<work><work-title>{escape(score['title'])}</work-title></work>")
    if score.get("composer"):
        out.append(f'<identification><creator type="composer">{escape(score["composer"])}</creator></identification>')
    out.append("<part-list>")
    for p in score["part"]:
        out.append(f"<score-part id={quoteattr(p['part_id'])}><part-name>{escape(p['name'] or '')}</part-name>" + (f"<part-abbreviation>{escape(p['abbreviation'])}</part-abbreviation>" if p["abbreviation"] else "") + "</score-part>")
    out.append("</part-list>")
    for p in score["part"]:
        mine = lambda rows: [r for r in rows if r["part_ord"] == p["part_ord"]]  # noqa: B023, E731
        measures, events, chords = mine(score["measure"]), mine(score["event"]), mine(score["chord"])
        staves = max((m["staff_no"] for m in measures), default=1)
        by_event: dict[tuple, list[dict]] = {}
        for e in events:
            by_event.setdefault((e["m_idx"], e["staff_no"], e["voice_no"]), []).append(e)
        out.append(f"<part id={quoteattr(p['part_id'])}>")
        time = None
        for m in sorted((m for m in measures if m["staff_no"] == 1), key=lambda m: m["m_idx"]):
            i = m["m_idx"]
            out.append(f"<measure number={quoteattr(m['m_number'] or str(i + 1))}" + (' implicit="yes"' if m["implicit"] else "") + ">")
            head = []
            if i == 0:
                head.append(f"<divisions>{q(quarter)}</divisions>")
            if m["key"]:
                head.append(f"<key><fifths>{m['key']['fifths']}</fifths>" + (f"<mode>{m['key']['mode']}</mode>" if m["key"]["mode"] else "") + "</key>")
            if m["time"]:
                time = (m["time"]["beats"], m["time"]["beat_type"])
                head.append(f"<time><beats>{time[0]}</beats><beat-type>{time[1]}</beat-type></time>")
            if i == 0 and staves > 1:
                head.append(f"<staves>{staves}</staves>")
            for s in sorted((x for x in measures if x["m_idx"] == i), key=lambda x: x["staff_no"]):
                for c in s["clefs"] or []:
                    if c["offset"]["num"] == 0:
                        head.append(f'<clef number="{s["staff_no"]}"><sign>{c["sign"]}</sign>' + (f"<line>{c['line']}</line>" if c["line"] else "") + (f"<clef-octave-change>{c['octave_change']}</clef-octave-change>" if c["octave_change"] else "") + "</clef>")
            if i == 0 and p["transpose_semitones"]:
                head.append(f"<transpose><chromatic>{p['transpose_semitones']}</chromatic></transpose>")
            if head:
                out.append("<attributes>" + "".join(head) + "</attributes>")
            out.append(_bar(m["left_barline"], "left"))
            for c in chords:
                if c["m_idx"] == i and c["staff_no"] == 1:
                    at = c["onset"]["num"] * quarter // c["onset"]["den"]
                    note = lambda tag, n: f"<{tag}><{tag}-step>{n[0]}</{tag}-step>" + (f"<{tag}-alter>{n.count('#') - n[1:].count('b')}</{tag}-alter>" if len(n) > 1 else "") + f"</{tag}>"
                    out.append("<harmony>" + note("root", c["root"]) + "<kind" + (f" text={quoteattr(c['text'])}" if c["text"] else "") + f">{c['kind'] or ''}</kind>" + (note("bass", c["bass"]) if c["bass"] else "") + (f"<offset>{q(at)}</offset>" if at else "") + "</harmony>")
            cursor, used = 0, {}
            for (j, staff, voice), es in sorted(by_event.items()):
                if j != i:
                    continue
                number = voice
                while used.get(number, staff) != staff:
                    number += 4
                used[number] = staff
                if cursor:
                    out.append(f"<backup><duration>{q(cursor)}</duration></backup>")
                    cursor = 0
                es = sorted(es, key=lambda e: e["ev_ord"])
                marks, beams = tuplet_marks(es), beam_marks(es, quarter, time)
                for k, e in enumerate(es):
                    if e["offset_ticks"] > cursor:
                        out.append(f"<forward><duration>{q(e['offset_ticks'] - cursor)}</duration></forward>")
                        cursor = e["offset_ticks"]
                    out += _notes(e, number, staff if staves > 1 else None, q(e["duration_ticks"]), marks.get(k), beams.get(k, []))
                    cursor += e["duration_ticks"]
            out.append(_bar(m["right_barline"], "right"))
            out.append("</measure>")
        out.append("</part>")
    out.append("</score-partwise>")
    return "\n".join(x for x in out if x) + "\n"


def _bar(b: dict | None, where: str) -> str:
    if not b:
        return ""
    ending = f'<ending number={quoteattr(b["ending"])} type={quoteattr(b["ending_type"] or "start")}/>' if b["ending"] else ""
    repeat = f'<repeat direction={quoteattr(b["repeat"])}/>' if b["repeat"] else ""
    return f'<barline location="{where}"><bar-style>{b["style"]}</bar-style>{ending}{repeat}</barline>'


def _notes(e: dict, voice: int, staff: int | None, duration: int, mark: str | None, beams: list[tuple[int, str]]) -> list[str]:
    rows = []
    heads = list(e["notes"] if e["notes"] is not None else [])
    for n, h in enumerate(heads or [None]):
        x = ["<note>", "<grace/>" if e["grace"] else "", "<chord/>" if n else ""]
        if h is None:
            x.append('<rest measure="yes"/>' if e["measure_rest"] else "<rest/>")
        else:
            p = h["pitch"]
            x.append(f"<pitch><step>{p['step']}</step>" + (f"<alter>{p['alter']}</alter>" if p["alter"] else "") + f"<octave>{p['octave']}</octave></pitch>")
        x.append("" if e["grace"] else f"<duration>{duration}</duration>")
        if h is not None:
            x += ['<tie type="stop"/>' if h["tie_stop"] else "", '<tie type="start"/>' if h["tie_start"] else ""]
        x += [f"<voice>{voice}</voice>", f"<type>{e['note_type']}</type>" if e["note_type"] else "", "<dot/>" * (e["dots"] or 0)]
        if e["tuplet"] is not None:
            x.append(f"<time-modification><actual-notes>{e['tuplet']['actual']}</actual-notes><normal-notes>{e['tuplet']['normal']}</normal-notes></time-modification>")
        x.append(f"<staff>{staff}</staff>" if staff else "")
        if n == 0:
            x += [f'<beam number="{level}">{kind}</beam>' for level, kind in beams]
            arts = list(e["articulations"] if e["articulations"] is not None else [])
            notations = (f'<tuplet type="{mark}"/>' if mark else "") + ("<fermata/>" if "fermata" in arts else "")
            plain = [a for a in arts if a != "fermata"]
            notations += "<articulations>" + "".join(f"<{a}/>" for a in plain) + "</articulations>" if plain else ""
            x.append(f"<notations>{notations}</notations>" if notations else "")
            x += [f'<lyric number="{y["verse"]}"><syllabic>{y["syllabic"]}</syllabic><text>{escape(y["text"])}</text>' + ("<extend/>" if y["extend"] else "") + "</lyric>" for y in (e["lyrics"] if e["lyrics"] is not None else [])]
        x.append("</note>")
        rows.append("".join(x))
    return rows


def _plain(v):  # noqa: ANN001, ANN202
    """Lists and dicts for what Arrow gives: arrays within rows within arrays."""
    if isinstance(v, np.ndarray) or isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v.asDict(recursive=True) if hasattr(v, "asDict") else v


def write_scores(scores: DataFrame) -> DataFrame:
    """(score_id, musicxml) of nested scores as ``read_scores`` gives them; scores with an error are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r["score_id"], render({k: _plain(v) for k, v in r.items()})) for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=["score_id", "musicxml"])

    return scores.filter("error IS NULL").select("score_id", "title", "composer", "part", "measure", "event", "chord", F.col("ticks_per_quarter")).mapInPandas(run, "score_id string, musicxml string")
