"""Subjects: held-out accuracy on made texts, pruning, headers, empty inputs."""

import random

from itertools import combinations

from stavework.llm import subjects
from stavework.llm.subjects import FOLDS, Rules, Tree, evidence, find_subjects, grow, learn, lower_bound, own_words, prune, without_header

SUBJECTS = {"music": "clef tempo octave chord sonata".split(), "law": "verdict bailiff felony clause tribunal".split(), "farming": "tractor barley orchard herd plough".split()}
PLAIN = "value index total return self record name size list count".split()


def text(rng, subjects):
    w = [rng.choice(PLAIN) for _ in range(40)]
    for s in subjects:
        w += [rng.choice(SUBJECTS[s]) for _ in range(8)]
    rng.shuffle(w)
    w.append(rng.choice(SUBJECTS[rng.choice(sorted(SUBJECTS))]))  # a passing mention
    return " ".join(w)


def test_held_out(spark):
    rng = random.Random(6)
    truth, docs, labels = {}, [], []
    for i in range(700):
        s = sorted(rng.sample(sorted(SUBJECTS), rng.choice([0, 1, 1, 1, 2])))
        truth[i] = s or ["software"]
        docs.append((i, text(rng, s)))
        if i < 400:
            wrong = rng.random() < 0.04
            labels += [(i, x.upper() if rng.random() < 0.1 else x) for x in ([rng.choice(sorted(SUBJECTS))] if wrong else truth[i])]
    docs += [(900, None), (901, ""), (902, "clef_tempo octaveChord SONATA tempo chord clef")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    rules = learn(d, spark.createDataFrame([*labels, (None, "law"), (1, None), (1, labels[1][1])], "doc_id bigint, subject string"))
    got = {}
    for r in find_subjects(d, rules).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    held = [i for i in range(400, 700)]
    assert sum(sorted(got[i]) == truth[i] for i in held) / len(held) > 0.97
    assert got[900] == got[901] == ["software"] and got[902] == ["music"]
    assert sorted(rules.single)[0] and all(w not in rules.single for w in PLAIN)


def test_pairs_at_every_place(spark):
    # the fourth and fifth telling word: each also stands alone in other subjects, together they tell
    of = {"x": ["alpha beta gamma peri quod"], "y": ["peri delta", "delta"], "z": ["quod epsil", "epsil"], "v": ["vau"], "w": ["wynn"]}
    rows = [(k, t, s) for k, (s, t) in enumerate((s, ts[i % len(ts)]) for s, ts in of.items() for i in range(60))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, subject string")
    rules = learn(d.select("doc_id", "text"), d.select("doc_id", "subject"))
    assert rules.longer[frozenset(("peri", "quod"))][0] == "x"


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "clef clef clef clef")], "doc_id bigint, text string")
    rules = learn(d, spark.createDataFrame([], "doc_id bigint, subject string"))
    assert [tuple(r) for r in find_subjects(d, rules).collect()] == [(1, "software", 1.0)]
    assert find_subjects(d.filter("doc_id > 5"), rules).count() == 0


def test_grow_finds_all_itemsets(monkeypatch):
    """FP-growth against counting every set of every document."""
    monkeypatch.setattr(subjects, "MIN_DOCS_LONGER", 3)
    rng = random.Random(8)
    docs = {d: [tuple(sorted(rng.sample("abcdef", rng.randrange(1, 5)))) for _ in range(rng.randrange(1, 4))] for d in range(60)}
    of_doc = {d: (rng.choice("xy"), d % FOLDS) for d in docs}
    tree = Tree()
    for d, sets in docs.items():
        for s in sets:
            tree.insert(s, {d})
    got = {words: (subject, n, of) for words, subject, n, of in grow(tree, ("z",), of_doc)}
    want = {}
    for size in (1, 2):
        for words in combinations("abcdef", size):
            has = [d for d, sets in docs.items() if any(set(words) <= set(s) for s in sets)]
            if len(has) >= 3:
                n = {s: sum(of_doc[d][0] == s for d in has) for s in "xy"}
                subject = max("xy", key=lambda s: (n[s], s))
                if n[subject] >= subjects.MIN_CONFIDENCE * len(has) - 1:
                    want[(*words, "z")] = subject, [sum(of_doc[d] == (subject, f) for d in has) for f in range(FOLDS)], [sum(of_doc[d][1] == f for d in has) for f in range(FOLDS)]
    assert got == want and len(want) > 5


def test_parts():
    shares = {"x": [20] * FOLDS, "y": [80] * FOLDS, "software": [100] * FOLDS}
    mined = {("a",): ("x", [10] * 5, [10] * 5), ("a", "b"): ("x", [9] * 5, [9] * 5), ("c", "d"): ("x", [2] * 5, [2] * 5), ("e",): ("x", [1, 1, 0, 0, 0], [1, 1, 0, 0, 0]), ("f",): ("software", [4] * 5, [9] * 5), ("g",): ("x", [5] * 5, [10] * 5)}
    assert [k for k, *_ in prune(mined, shares)] == [("a",), ("e",), ("c", "d")]
    assert [k for k, *_ in prune(mined, shares, without=0)] == [("a",), ("c", "d")]
    assert evidence(1, 1, 0.1) is None and evidence(2, 2, 0.1) > 0 and evidence(2, 2, 0.1, words=2) is None and lower_bound(50, 50) > 0.94
    assert without_header("// Copyright 2020 X.\n// Licence terms.\n\ncode law") == "\ncode law" and without_header("# a note\ncode") == "# a note\ncode" and without_header("Licence of X\n1. law") == "Licence of X\n1. law"
    assert own_words("fooBar_baz QUX2x") == ["foo", "bar", "baz", "qux"] and own_words(None) == []
    r = Rules([(("ledger",), "finance", 0.9), (("pitch", "umpire"), "sport", 0.8)], 1.5, "software", [(0.0, 0.0), (1.0, 0.25), (1.5, 0.75)])
    assert r.subjects(["ledger", "ledger"]) == [("finance", 0.75)] and r.subjects(["ledger"]) == [("software", 1.0)] and r.subjects(["ledger", "pitch", "umpire"]) == [("software", 1.0)]
    own = Rules([(("mutex",), "software", 1.0), (("ledger",), "finance", 1.0)], 1.5, "software")
    assert [x for x, _ in own.subjects(["mutex", "mutex", "ledger", "ledger"])] == ["finance", "software"]
    assert r.scores(["pitch", "umpire", "pitch", "umpire"]) == {"sport": 0.8}
