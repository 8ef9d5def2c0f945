"""Repeats of items in any layout, against a plain check of both rules."""

import json
import math
import random
from collections import Counter

import numpy as np

from stavework.llm import leakage
from stavework.llm.leakage import ItemIndex, drop_numbers, find_repeats, leaked_items, retrieve, undo_layout, words

RNG = random.Random(8)
VOCAB = [f"w{i}" for i in range(40)] + [str(i) for i in range(1, 60)] + ["the", "of", "a", "to"] * 3
ITEMS = [(i, " ".join(RNG.choice(VOCAB) for _ in range(RNG.randrange(60, 140)))) for i in range(40)]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        d = 0
        for j, y in enumerate(b, 1):
            d, row[j] = row[j], d + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain(text):
    return sorted({i for t in (undo_layout(text), drop_numbers(undo_layout(text))) for i in repeated(t)})


def repeated(text):
    w, out = words(text), []
    for i, t in ITEMS:
        o = words(t)
        runs = {tuple(o[k : k + 20]) for k in range(len(o) - 19)}
        if any(tuple(w[k : k + 20]) in runs for k in range(len(w) - 19)) or any(common(o, w[s : s + 2 * len(o)]) >= math.ceil(0.7 * len(o)) for s in range(max(1, len(w) - 2 * len(o) + 1))):
            out.append(i)
    return out


def documents():
    filler = lambda n: " ".join(RNG.choice(["int", "return", "x", "if", "the", "12", "w3", "value"]) for _ in range(n))
    docs = ["", None, filler(300)]
    for k in range(12):
        i, t = ITEMS[k]
        w = t.split()
        edit = [x if RNG.random() > 0.2 else RNG.choice(VOCAB) for x in w if RNG.random() > 0.1 * (k % 4)]
        docs += [filler(50) + " " + " ".join(w[5 : 5 + 17 + k % 6]) + " " + filler(60), filler(40) + " " + " ".join(edit) + " " + filler(30), " ".join(RNG.sample(w, len(w)))]
    return docs


def test_equals_plain_check():
    ix, docs = ItemIndex([(i, words(t)) for i, t in ITEMS]), documents()
    want = [(d, i) for d, t in enumerate(docs) if t for i in plain(t)]
    assert sorted(find_repeats(ix, docs)) == want and len(want) > 7
    assert find_repeats(ix, []) == [] and find_repeats(ItemIndex([]), docs) == []


def test_layouts():
    ix = ItemIndex([(i, words(t)) for i, t in ITEMS])
    w = ITEMS[3][1].split()
    lines = [" ".join(w[o : o + 6]) for o in range(0, len(w), 6)]
    camel = "".join(x.capitalize() for x in w if not x.isdigit())
    shown = [
        "\n".join("// " + x for x in lines),
        "\n".join(f" * {k + 1}: {x}" for k, x in enumerate(lines)),
        json.dumps("\n".join(lines)),
        "<pre>\n" + "\n".join(x.replace(" ", "&nbsp;", 1) for x in lines) + "</pre>",
        "(\n" + "\n".join(f'    "{x} "' for x in lines) + "\n)",
        ITEMS[3][1].upper(),
        "x = " + "%20".join(w),
    ]
    assert [t for t, i in find_repeats(ix, shown) if i == 3] == list(range(len(shown)))
    assert words("paleGateHTMLText z2")[:4] == ["pale", "gate", "html", "text"] and camel


def numbered(w, a, n, first):
    """Words a line at a time, ``n`` to a line, each line with its number."""
    lines = [" ".join(w[o : o + n]) for o in range(0, len(w), n)]
    return "\n".join(f"{first + k}{a} {x}" for k, x in enumerate(lines))


def test_numbered_lines_lose_no_repeat():
    ix = ItemIndex([(i, words(t)) for i, t in ITEMS])
    rng = random.Random(12)
    for n in range(1, 9):
        docs, want = [], []
        for i, t in rng.sample(ITEMS, 8):
            w = t.split()
            o = rng.randrange(len(w) - 19)
            left_out = set(rng.sample(range(len(w)), int(len(words(t)) * 0.28)))
            part = [x for k, x in enumerate(w) if k not in left_out]
            for x in (w[o : o + 20], part):
                docs.append("int main\n" + numbered(x, rng.choice([":", ".", "|", " "]), n, rng.randrange(1, 900)) + "\nreturn value")
                want.append(i)
        got = set(find_repeats(ix, docs))
        assert all((d, i) in got for d, i in enumerate(want)), n


def test_items_with_numbered_lines():
    text = "\n".join(f"{k}. {' '.join(RNG.choice(VOCAB) for _ in range(4))}" for k in range(1, 12))
    assert find_repeats(ItemIndex([(5, words(text))]), ["x\n" + text, text.replace("\n", "\n// ")]) == [(0, 5), (1, 5)]


def test_retrieval_against_all_scores():
    """What the index retrieves is what scores high enough, whatever it skips."""
    rng = random.Random(3)
    items = [(i, [f"t{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randrange(1, 60))]) for i in range(61)]
    ix = ItemIndex(items)
    passages = [[f"t{int(rng.paretovariate(0.6)) % 120}" for _ in range(rng.randrange(0, 50))] for _ in range(80)]
    at = [(p, ix.written[w]) for p, ws in enumerate(passages) for w in ws if w in ix.written]
    least, shared = np.array([rng.uniform(2, 40) for _ in items]), np.array([rng.randrange(1, 9) for _ in items])
    p, j = retrieve(ix, np.array([x for x, _ in at]), np.array([t for _, t in at]), least, shared)
    want = set()
    impact = {(k // len(items), k % len(items)): x for k, x in zip(ix.post_key.tolist(), ix.post_impact.tolist())}
    for x, ws in enumerate(passages):
        for k, (_, own) in enumerate(items):
            common = {w: min(n, own.count(w)) for w, n in Counter(ws).items() if w in own}
            if common and sum(n * impact[ix.written[w], k] for w, n in common.items()) >= least[k] and sum(common.values()) >= shared[k]:
                want.add((x, k))
    assert set(zip(p.tolist(), j.tolist())) == want and len(want) > 50


def test_several_indexes(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS", 7)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, "x " + t) for i, t in ITEMS], "doc_id bigint, text string")
    assert {tuple(r) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(i, j) for i, t in ITEMS for j in plain(t)}


def test_tables(spark):
    items = spark.createDataFrame([*ITEMS, (77, None), (78, ""), (None, "a b"), (79, ITEMS[0][1])], "item_id bigint, text string")
    long = "filler " * 30_000 + ITEMS[0][1] + " more" * 10
    docs = spark.createDataFrame([(1, long, 5), (2, None, 5), (3, "", 5), (4, "nothing here", 5)], "doc_id bigint, text string, item_id int")
    got = {tuple(r) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 0), (1, 79)}
    assert leaked_items(docs.filter("doc_id > 9"), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaked_items(docs, "doc_id", "text", items.filter("item_id > 900"), "item_id", "text").count() == 0
