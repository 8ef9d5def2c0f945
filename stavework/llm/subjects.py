"""Subjects of documents by class-association rules: mined with parallel FP-growth, pruned, scored with calibrated evidence."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.runtime import Shared, drop_table, materialize

#: Labelled documents that the rules are learnt from, at most; those with the smallest hash of their id.
MAX_LABELLED = 50_000
#: Documents that must hold a rule's word, or its several words, as there are many more sets of words than words.
MIN_DOCS, MIN_DOCS_LONGER = 2, 5
#: Words of one rule, and telling words within which they must lie.
MOST_WORDS, WINDOW = 3, 4
#: The share of a rule's documents that have its subject, what this share is surely above (for a rule of several words), and what a longer rule must gain over a shorter one.
MIN_CONFIDENCE, SURE, SURE_LONGER, GAIN = 0.6, 0.3, 0.5, 0.1
#: The share of a word's documents that surely has one subject, so that longer rules are tried with it; at least so much more than by chance.
TELLING, TIMES = 0.4, 1.5
#: Parts of the labelled documents; each is scored with the rules of the others.
FOLDS = 5

_WORD = re.compile(r"[A-Z]+(?![^\W\d_A-Z])|[A-Z]?[^\W\d_A-Z]+")
_COMMENT = re.compile(r"\s*(?://|#|--|/?\*|;|<!--|%|>|\"\"\")")
_NOTICE = re.compile(r"copyright|licen[cs]|all rights", re.I)


def own_words(text: str | None) -> list[str]:
    """Words of a text, lower case, joined and snake case names cut, without the licence header."""
    if not text:
        return []
    return [w.lower() for w in _WORD.findall(without_header(text)) if len(w) > 1]


def without_header(text: str) -> str:
    """Without the first block of comment lines if it is a licence notice."""
    end, seen, notice = 0, False, False
    while end < len(text):
        cut = text.find("\n", end)
        line = text[end : cut if cut >= 0 else len(text)]
        if not _COMMENT.match(line):
            if line.strip() or seen:
                break
        else:
            seen = True
            notice = notice or bool(_NOTICE.search(line))
        end = cut + 1 if cut >= 0 else len(text)
    return text[end:] if notice else text


def lower_bound(n: float, of: float) -> float:
    """What the share n / of is at least, with 95 % certainty (lower end of Wilson's interval)."""
    z2, p = 1.645**2, n / of
    return (p + z2 / (2 * of) - math.sqrt(z2 * (p * (1 - p) / of + z2 / (4 * of * of)))) / (1 + z2 / of)


def evidence(n: int, of: int, share: float, words: int = 1) -> float | None:
    """The weight of a rule: the log odds of its confidence's lower bound over those of the subject's share of documents; None for no rule."""
    if of < (MIN_DOCS if words == 1 else MIN_DOCS_LONGER) or n < MIN_CONFIDENCE * of:
        return None
    sure = lower_bound(n, of)
    if sure <= max(SURE if words == 1 else SURE_LONGER, share) or not 0 < share < 1:
        return None
    return math.log(sure / (1 - sure)) - math.log(share / (1 - share))


#: Of one itemset and its most frequent subject: in each fold the documents with both, and with the itemset.
Mined = dict[tuple[str, ...], tuple[str, list[int], list[int]]]


class Rules:
    """Pruned rules with their evidence, the score from which a subject counts, and the probability that a score stands for."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float]], threshold: float, rest: str, curve: list[tuple[float, float]] | None = None):
        self.single = {words[0]: (subject, w) for words, subject, w in rules if len(words) == 1}
        self.longer = {frozenset(words): (subject, w) for words, subject, w in rules if len(words) > 1}
        self.members = {w for words in self.longer for w in words}
        self.sizes = sorted({len(k) for k in self.longer})
        self.threshold, self.rest, self.curve = threshold, rest, curve or [(0.0, 1.0)]

    def scores(self, words: list[str]) -> dict[str, float]:
        """Evidence of each subject: a word's rule counts at every place, a longer rule once, as such words meet by chance in long texts."""
        out: dict[str, float] = defaultdict(float)
        near: list[str] = []
        met: set[frozenset] = set()
        single, members = self.single, self.members
        for w in words:
            hit = single.get(w)
            if hit:
                out[hit[0]] += hit[1]
            if w in members:
                near = [*near[-(WINDOW - 1) :], w]
                met.update(k for size in self.sizes for k in map(frozenset, combinations(near, size)) if w in k and k in self.longer)
        for k in met:
            subject, e = self.longer[k]
            out[subject] += e
        return out

    def probability(self, score: float) -> float:
        return self.curve[max(0, bisect_right(self.curve, (score, math.inf)) - 1)][1]

    def subjects(self, words: list[str]) -> list[tuple[str, float]]:
        """The subjects with their probabilities; without any the rest's, which is that of no other subject."""
        scores = self.scores(words)
        found = sorted((s, self.probability(x)) for s, x in scores.items() if x >= self.threshold)
        return found or [(self.rest, 1 - max((self.probability(x) for x in scores.values()), default=0.0))]


def prune(mined: Mined, shares: dict[str, list[int]], without: int | None = None) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules of the mined itemsets, counted over all folds but one; a rule that is hardly surer than one with fewer of the same words is dropped."""
    keep = [f for f in range(FOLDS) if f != without]
    total = sum(sum(n[f] for f in keep) for n in shares.values())
    sure: dict[tuple[tuple[str, ...], str], float] = {}
    out = []
    for words in sorted(mined, key=lambda k: (len(k), k)):
        subject, n, of = mined[words]
        n, of = sum(n[f] for f in keep), sum(of[f] for f in keep)
        weight = evidence(n, of, sum(shares[subject][f] for f in keep) / total, len(words)) if total and of else None
        if weight is None:
            continue
        here = lower_bound(n, of)
        if any(sure.get((k, subject), -1.0) >= here - GAIN for size in range(1, len(words)) for k in combinations(words, size)):
            continue
        sure[words, subject] = here
        out.append((words, subject, weight))
    return out


class Tree:
    """An FP-tree over the documents of one conditional pattern base: nodes hold the documents that pass them."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.heads: dict[str, list[tuple]] = defaultdict(list)

    def insert(self, items: tuple[str, ...], docs: set[int]) -> None:
        level, above = self.root, None
        for item in items:
            node = level.get(item)
            if node is None:
                node = level[item] = (item, set(), {}, above)
                self.heads[item].append(node)
            node[1].update(docs)
            level, above = node[2], node

    def documents(self, item: str) -> set[int]:
        return set().union(*(node[1] for node in self.heads[item]))

    def given(self, item: str) -> Tree:
        """The tree of what lies above the item."""
        out = Tree()
        for node in self.heads[item]:
            path, above = [], node[3]
            while above is not None:
                path.append(above[0])
                above = above[3]
            if path:
                out.insert(tuple(reversed(path)), node[1])
        return out


def grow(tree: Tree, suffix: tuple[str, ...], of_doc: dict[int, tuple[str, int]]) -> Iterator[tuple[tuple[str, ...], str, list[int], list[int]]]:
    """FP-growth: all itemsets of the tree with the suffix, each with its most frequent subject and the documents by fold."""
    for item in tree.heads:
        docs = tree.documents(item)
        if len(docs) < MIN_DOCS_LONGER:
            continue
        words = tuple(sorted((item, *suffix)))
        subject, most = max(Counter(of_doc[d][0] for d in docs).items(), key=lambda x: (x[1], x[0]))
        n, of = [0] * FOLDS, [0] * FOLDS
        for d in docs:
            of[of_doc[d][1]] += 1
            n[of_doc[d][1]] += of_doc[d][0] == subject
        if most >= MIN_CONFIDENCE * len(docs) - 1:
            yield words, subject, n, of
        if len(words) < MOST_WORDS:
            yield from grow(tree.given(item), (item, *suffix), of_doc)


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, subjects, fold, words); copies of a text are in one fold."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("subject")).alias("subject")).filter("doc_id IS NOT NULL AND subject <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([own_words(t) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "subjects", "words"])

    # at most max_labelled ids: bounded, so every task may hold them
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    cut = joined.select("doc_id", "subjects", "text").mapInArrow(read, "doc_id bigint, subjects array<string>, words array<string>")
    return materialize(cut.withColumn("fold", F.pmod(F.xxhash64("words"), F.lit(FOLDS)).cast("int")), "labelled")


def learn(docs: DataFrame, labels: DataFrame, rest: str = "software", max_labelled: int = MAX_LABELLED) -> Rules:
    """Rules from labelled documents.

    Parallel FP-growth. The documents of each word and subject are counted first (one aggregate): these are the frequent
    sets of one word. Then every run of WINDOW telling words of a document, one beginning at each, gives its words' tasks
    their conditional transactions: the words more frequent than the task's own. A task builds the FP-tree of each of its
    words and grows it to rules of at most MOST_WORDS words. Nodes hold documents, so that support and confidence count
    documents however long they are. Words sure enough already for no longer rule to gain on them are left out.

    A rule's evidence is the log odds of its confidence's lower bound over the subject's share. Counts are kept by fold,
    so that the rules of the other folds are known for each: every labelled document is scored with rules it had no part
    in. From these scores come the probability that a score stands for (isotonic) and the score from which a subject
    counts. Only documents of one subject give rules; labels may be wrong, twice, and of changing case. Without labels no
    rule is found and every document gets ``rest``. What reaches the driver follows the words of at most ``max_labelled``
    documents.
    """
    known = _labelled(docs, labels, max_labelled)
    one = known.filter("size(subjects) = 1").select("doc_id", F.col("subjects")[0].alias("subject"), "fold", "words")
    by_fold = [F.count_if(F.col("fold") == f).alias(f"f{f}") for f in range(FOLDS)]
    shares = {r["subject"]: [int(r[f"f{f}"]) for f in range(FOLDS)] for r in one.groupBy("subject").agg(*by_fold).collect()}
    total = sum(map(sum, shares.values()))
    if not total:
        drop_table(known)
        return Rules([], 1.0, rest)
    seen = one.select("subject", "fold", F.explode(F.array_distinct("words")).alias("word")).groupBy("word", "subject").agg(F.count(F.lit(1)).alias("n"), F.array(*by_fold).alias("by_fold"))
    words = seen.groupBy("word").agg(
        F.sum("n").alias("df"), F.max(F.struct("n", "subject", "by_fold")).alias("m"), F.array(*[F.sum(F.col("by_fold")[f]) for f in range(FOLDS)]).alias("of")
    ).filter(F.col("df") >= MIN_DOCS)
    share = F.create_map(*[F.lit(x) for s, k in shares.items() for x in (s, sum(k) / total)])
    words = words.withColumn("confidence", F.col("m.n") / F.col("df")).filter((F.col("confidence") >= MIN_CONFIDENCE * 0.9) | (F.col("confidence") >= F.greatest(F.lit(TELLING), TIMES * share[F.col("m.subject")])))
    mined: Mined = {}
    rank: dict[str, tuple[int, str]] = {}
    for r in words.select("word", "m.subject", "m.by_fold", "of", "df", "m.n").collect():
        mined[(r["word"],)] = r["subject"], list(r["by_fold"]), list(r["of"])
        # a longer rule needs to gain, and can't be surer than all of its documents make it
        least = max(TELLING, TIMES * sum(shares[r["subject"]]) / total)
        if least <= lower_bound(r["n"], r["df"]) < lower_bound(r["n"], r["n"]) - GAIN:
            rank[r["word"]] = -r["df"], r["word"]
    mined.update(_longer(one, rank))
    rules = [prune(mined, shares, f) for f in range(FOLDS)]
    threshold, curve = _calibrate(known, [Rules(r, 1.0, rest) for r in rules], rest)
    drop_table(known)
    return Rules(prune(mined, shares), threshold, rest, curve)


def _longer(one: DataFrame, rank: dict[str, tuple[int, str]]) -> Mined:
    """Itemsets of several words; ``rank`` orders the words that are tried, the most frequent first."""
    if not rank:
        return {}

    def conditional(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, s, f, ws in zip(*(c.to_pylist() for c in b.columns)):
                kept = [w for w in ws if w in rank]
                windows = {tuple(sorted(set(kept[o : o + WINDOW]), key=rank.__getitem__)) for o in range(max(1, len(kept) - WINDOW + 1))}
                rows += [(w, items, d, s, f) for w, items in sorted({(x[k], x[:k]) for x in windows for k in range(1, len(x))})]
            if rows:
                w, items, d, s, f = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(items, pa.list_(pa.string())), pa.array(d, pa.int64()), pa.array(s), pa.array(f, pa.int32())], names=["word", "items", "doc_id", "subject", "fold"])

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Transactions come in order of their word; its tree is grown when the next begins."""
        own, tree, of_doc, out = None, Tree(), {}, []
        for b in batches:
            for w, items, d, s, f in zip(*(c.to_pylist() for c in b.columns)):
                if w != own and own is not None:
                    out += grow(tree, (own,), of_doc)
                    tree, of_doc = Tree(), {}
                own = w
                tree.insert(tuple(items), {d})
                of_doc[d] = s, f
            if len(out) > 10_000:
                yield batch(out)
                out = []
        yield batch(out + (list(grow(tree, (own,), of_doc)) if own is not None else []))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = pa.list_(pa.string()), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["words", "subject", "n", "of"])

    given = one.select("doc_id", "subject", "fold", "words").mapInArrow(conditional, "word string, items array<string>, doc_id bigint, subject string, fold int")
    by_word = given.repartition("word").sortWithinPartitions("word", "items").select("word", "items", "doc_id", "subject", "fold")
    found = by_word.mapInArrow(mine, "words array<string>, subject string, n array<bigint>, of array<bigint>")
    return {tuple(r["words"]): (r["subject"], list(r["n"]), list(r["of"])) for r in found.collect()}


#: Scores are counted in steps of 1 / STEPS, up to MOST.
STEPS, MOST = 4, 400


def _calibrate(known: DataFrame, rules: list[Rules], rest: str) -> tuple[float, list[tuple[float, float]]]:
    """The score from which a subject counts, and the probability by score, from documents scored with the rules of other folds.

    The histogram of scores, not the scores, is collected. Probabilities rise with the score (pool adjacent violators).
    Of the scores that give the labels back best (by F1, to a thousandth) the one is taken around which the fewest scores lie:
    between passing mentions and what a text is about.
    """
    shared = Shared(known.sparkSession, rules)

    def hist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for subjects, fold, ws in zip(*(c.to_pylist() for c in b.columns)):
                x = shared.value[fold].scores(ws)
                for s in {*x, *subjects}:
                    if s != rest:
                        n[(min(MOST, round(x.get(s, 0.0) * STEPS)), s in subjects)] += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n]), pa.array([y for _, y in n]), pa.array(list(n.values()), pa.int64())], names=["k", "y", "n"])

    rows = known.select("subjects", "fold", "words").mapInArrow(hist, "k bigint, y boolean, n bigint").groupBy("k", "y").agg(F.sum("n").alias("n")).collect()
    yes, no = Counter(), Counter()
    for r in rows:
        (yes if r["y"] else no)[int(r["k"])] += int(r["n"])
    pools: list[list[float]] = []  # score, yes, all
    for k in sorted({*yes, *no} - {0}):
        pools.append([k / STEPS, yes[k], yes[k] + no[k]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, y, n = pools.pop()
            pools[-1][1] += y
            pools[-1][2] += n
    curve = [(0.0, 0.0), *((x, y / n) for x, y, n in pools)]
    all_yes, best = sum(yes.values()), {}
    for t in range(2, MOST):
        hit = sum(v for k, v in yes.items() if k >= t)
        wrong = sum(v for k, v in no.items() if k >= t)
        best[t] = 2 * hit / (hit + wrong + all_yes) if all_yes else 0.0
    top = max(best.values(), default=0.0)
    good = [t for t, f in best.items() if f >= top - 0.001 and f > 0] or [4 * STEPS]
    around = {t: sum((yes[k] + no[k]) / (1 + abs(k - t)) for k in range(max(1, t - 8), t + 8)) for t in good}
    return min(good, key=lambda t: (around[t], t)) / STEPS, curve


def find_subjects(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, subject, probability), one row for each subject of each row of ``docs(doc_id, text)``; at least one.

    A narrow scan of whole texts with the rules sent to the workers. The rest is a subject like the others, and also that
    of null and empty texts and of texts about no other.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = Shared(docs.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        telling = {*r.single, *r.members}
        written = {x: t for t in telling for x in (t.upper(), t.capitalize(), t)}
        get = written.get
        for b in batches:
            at, names, sure = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ws = [w for w in map(get, _WORD.findall(without_header(text))) if w] if text else []
                for s, p in r.subjects(ws):
                    at.append(k)
                    names.append(s)
                    sure.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "subject", "probability"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, subject string, probability double")
