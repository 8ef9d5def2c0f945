"""Queries on training data, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm import percentiles as pct
from stavework.llm.leakage import leaked_items
from stavework.llm.names import with_persons
from stavework.llm.packing import count_tokens, pack
from stavework.llm.sampling import matched_sample
from stavework.llm.splits import assign_splits, connected_components, star_edges
from stavework.llm.subjects import find_subjects, learn
from stavework.llm.topn import top_n
from stavework.runtime import latest, load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def _few(table: DataFrame, most: int = 1000) -> list:
    """All rows of a table of settings; more than ``most`` are an error, as they go to every task."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of settings")
    return rows


# --- 1: splits that keep related records together


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "openscore").select("piece_no", "loaded_at", "id", "work", "engraver")
    return latest(o.filter("piece_no IS NOT NULL"), "piece_no", "loaded_at")


def _named_ids(column: str) -> Column:
    """What can be a piece id in a sample_group: runs of words joined by hyphens."""
    return F.expr(f"regexp_extract_all(lower({column}), '[a-z0-9_]+(?:-[a-z0-9_]+)+', 0)")


def _links(pieces: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between pieces of one composer, one engraver, or one sample_group."""
    named = with_persons(pieces.withColumn("composer", F.substring_index("work", "/", 1)), "piece_no", {"composer": True, "engraver": False})
    persons = named.select("key", F.concat_ws(":", "field", "person").alias("person"))
    ids = pieces.select(F.lower(F.trim("id")).alias("id"), "piece_no")
    in_group = groups.select(F.col("sample_group").alias("g"), F.explode(F.array_distinct(_named_ids("sample_group"))).alias("id"))
    together = in_group.join(ids, "id").select("piece_no", "g")
    return star_edges(persons, "key", "person").union(star_edges(together, "piece_no", "g"))


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = load(spark, sf_dir, "samples").select("sample_group").filter("sample_group IS NOT NULL").distinct()
    c = connected_components(_links(_pieces(spark, sf_dir), groups))
    return c.filter("node <> root").select(F.col("root").alias("root_piece_no"), F.col("node").alias("piece_no"))


@query()
def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of each openscore piece and labelled sample; pieces divided nearly in the shares.

    Beside the links of p1_found, a sample_group also ties seed pieces and ids of unknown pieces, so that samples of one
    group, or of groups that share a piece, never part. Samples without a group stand alone.
    """
    pieces = _pieces(spark, sf_dir)
    samples = latest(load(spark, sf_dir, "samples").select("sample_no", "sample_group").filter("sample_no IS NOT NULL"), "sample_no", "sample_group")
    groups = samples.select("sample_group").filter("sample_group IS NOT NULL").distinct()
    ids = pieces.select(F.lower(F.trim("id")).alias("id"), "piece_no")
    # other ids become nodes below zero, by a hash of the id; a group without an id is named by its own text
    named = groups.select("sample_group", F.explode(F.when(F.size(_named_ids("sample_group")) > 0, F.array_distinct(_named_ids("sample_group"))).otherwise(F.array(F.lower(F.trim("sample_group"))))).alias("id"))
    other = -F.shiftrightunsigned(F.xxhash64("id"), 2) - 1
    nodes = named.join(ids, "id", "left").select("sample_group", F.coalesce("piece_no", other).alias("node"))
    edges = _links(pieces, groups).union(star_edges(nodes, "node", "sample_group"))
    root = connected_components(edges)
    of_piece = pieces.select("piece_no").join(root.withColumnRenamed("node", "piece_no"), "piece_no", "left").select("piece_no", F.coalesce("root", "piece_no").alias("root"))
    sizes = of_piece.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    shares = {name: float(share) for name, share in _few(load(spark, sf_dir, "split_shares").select("split_name", "share"))}
    split = assign_splits(sizes, shares).select("root", "split")
    # components of samples only have no piece to count; a hash divides them in the shares
    u, upto, by_hash = F.pmod(F.xxhash64("root", F.lit(5)), F.lit(1_000_000)) / 1e6, 0.0, F.lit(None).cast("string")
    for name in sorted(shares, key=lambda s: (shares[s], s)):
        upto += shares[name] / (sum(shares.values()) or 1.0)
        by_hash = F.coalesce(by_hash, F.when(u < upto, F.lit(name)))
    by_hash = F.coalesce(by_hash, F.lit(max(shares, key=lambda s: shares[s], default=None)))
    group_node = nodes.groupBy("sample_group").agg(F.min("node").alias("node"))
    group_root = group_node.join(root, "node", "left").select("sample_group", F.coalesce("root", "node").alias("root"))
    group_split = group_root.join(split, "root", "left").select("sample_group", F.coalesce("split", by_hash).alias("split"))
    lone = samples.filter("sample_group IS NULL").select("sample_no", (-F.col("sample_no") - 1).alias("root"))
    out = of_piece.join(split, "root").select(F.lit("piece").alias("kind"), F.col("piece_no").alias("id"), "split")
    out = out.union(samples.join(group_split, "sample_group").select(F.lit("sample"), "sample_no", "split"))
    return out.union(lone.select(F.lit("sample"), "sample_no", by_hash))


# --- 2: percentiles

QS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "score_event").select("event_no", "loaded_at", "part_name", "recorded_at", "confidence")
    e = latest(e, "event_no", "loaded_at")
    return e.select(F.lower(F.trim("part_name")).alias("part_name"), F.to_date("recorded_at").alias("day"), "confidence")


@query()
def p2_part_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are summarised apart, then combined."""
    days = pct.summarise(_events(spark, sf_dir), ["part_name", "day"], "confidence")
    return pct.percentiles(pct.combine(days, ["part_name"]), QS)


@query()
def p2_day_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pct.percentiles(pct.summarise(_events(spark, sf_dir), ["part_name", "day"], "confidence"), QS)


@query()
def p2_measure_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the events within review_measure."""
    m = load(spark, sf_dir, "review_measure").select("measure_no", "loaded_at", "part_name", F.col("events.confidence").alias("confidence"))
    m = latest(m, "measure_no", "loaded_at").select(F.lower(F.trim("part_name")).alias("part_name"), F.explode("confidence").alias("confidence"))
    return pct.percentiles(pct.summarise(m, ["part_name"], "confidence"), QS)


@query("""
    WITH e AS (SELECT lower(trim(part_name)) AS part_name, confidence FROM (SELECT *, row_number() OVER (PARTITION BY event_no ORDER BY loaded_at DESC) AS rn FROM score_event) WHERE rn = 1)
    SELECT part_name, count(*) AS n_values, true AS within_error FROM e WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY part_name""")
def p2_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the true ranks of all percentiles given lie within the stated error."""
    e = _events(spark, sf_dir).filter("confidence IS NOT NULL AND NOT isnan(confidence)").select("part_name", "confidence")
    p = p2_part_percentiles(spark, sf_dir).withColumnRenamed("part_name", "p")
    both = e.join(p, F.col("part_name").eqNullSafe(F.col("p")))
    below = [F.count_if(F.col("confidence") < F.col(q)).alias(f"below_{q}") for q in QS]
    upto = [F.count_if(F.col("confidence") <= F.col(q)).alias(f"upto_{q}") for q in QS]
    n = both.groupBy("part_name").agg(F.count(F.lit(1)).alias("n"), F.first("n_values").alias("n_values"), F.first("rank_error").alias("err"), *below, *upto)
    right = F.col("n") == F.col("n_values")
    for q, share in QS.items():
        rank = F.greatest(F.ceil(F.col("n") * share), F.lit(1))
        right = right & (F.col(f"below_{q}") + 1 - rank <= F.col("err") * F.col("n") + 1e-6) & (rank - F.col(f"upto_{q}") <= F.col("err") * F.col("n") + 1e-6)
    return n.select("part_name", "n_values", right.alias("within_error"))


# --- 3: a sample that matches shares

#: Spellings of categories and languages, lower case without blanks, dots and hyphens.
CATEGORIES = {
    "song": ("song", "songs", "lied", "lieder"),
    "quartet": ("quartet", "quartets", "stringquartet", "stringquartets"),
    "piano": ("piano", "pianos", "pianosolo"),
    "satb": ("satb",),
    "leadsheet": ("leadsheet", "leadsheets"),
    "solo": ("solo", "solos"),
}
LANGUAGES = {
    "deu": ("deu", "de", "ger", "german", "deutsch"),
    "fra": ("fra", "fr", "fre", "french", "francais", "français"),
    "eng": ("eng", "en", "english"),
    "ita": ("ita", "it", "italian", "italiano"),
    "lat": ("lat", "la", "latin"),
    "none": ("", "none", "zxx", "null", "na"),
}


def _spelt(column: str, table: dict[str, tuple[str, ...]], missing: str | None) -> Column:
    """The table's key for a spelling; null for others; ``missing`` for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[\s._\-/]+", "")
    x = F.lit(None).cast("string")
    for key, ways in table.items():
        x = F.when(plain.isin(*ways), F.lit(key)).otherwise(x)
    return F.when(F.col(column).isNull(), F.lit(missing).cast("string")).otherwise(x)


def _all_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = None
    for t in ("openscore", "seed"):
        p = load(spark, sf_dir, t).select("piece_no", "loaded_at", "category", "language").filter("piece_no IS NOT NULL")
        both = p if both is None else both.union(p)
    p = latest(both, "piece_no", "loaded_at")
    return p.select("piece_no", _spelt("category", CATEGORIES, None).alias("category"), _spelt("language", LANGUAGES, "none").alias("language"))


def _sample(spark: SparkSession, sf_dir: str):
    return matched_sample(_all_pieces(spark, sf_dir), "piece_no", [(["category", "language"], load(spark, sf_dir, "category_targets"))])


def _spell_sql(column: str, table: dict[str, tuple[str, ...]], missing: str) -> str:
    plain = f"regexp_replace(lower(coalesce({column}, '')), '[\\s._\\-/]+', '', 'g')"
    whens = " ".join(f"WHEN {plain} IN ({', '.join(repr(w) for w in ways)}) THEN '{key}'" for key, ways in table.items())
    return f"CASE WHEN {column} IS NULL THEN {missing} {whens} END"


_NEEDS_SQL = f"""
    WITH p AS (SELECT piece_no, category, language FROM (
        SELECT *, row_number() OVER (PARTITION BY piece_no ORDER BY loaded_at DESC) AS rn FROM (
            SELECT piece_no, category, language, loaded_at FROM openscore UNION ALL SELECT piece_no, category, language, loaded_at FROM seed)) WHERE rn = 1),
    c AS (SELECT {_spell_sql("category", CATEGORIES, "NULL")} AS category, {_spell_sql("language", LANGUAGES, "'none'")} AS language FROM p),
    n AS (SELECT category, language, count(*) AS available FROM c GROUP BY ALL),
    r AS (SELECT t.category, t.language, greatest(CAST(ceil(CAST(t.share AS DECIMAL(18, 6)) * ((SELECT count(*) FROM p) // 5)) AS BIGINT), t.min_rows) AS needed, coalesce(n.available, 0) AS available
        FROM category_targets t LEFT JOIN n USING (category, language))
"""


@query(_NEEDS_SQL + "SELECT category, language FROM r WHERE available < needed")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that the repaired sample doesn't meet, but for those that lack rows only as all needs, each rounded up, exceed its size."""
    return _sample(spark, sf_dir).reports[0].filter("NOT met AND available < needed").select("category", "language")


@query(_NEEDS_SQL + "SELECT category, language, needed, available, available >= needed AS met FROM r")
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the repaired sample holds; SQL says what it can hold."""
    return _sample(spark, sf_dir).reports[0].select("category", "language", "needed", "available", "met")


@query()
def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).rows


@query(
    _NEEDS_SQL
    + """, one AS (SELECT 'category' AS field, category AS value, sum(share) AS share, sum(min_rows) AS min_rows FROM category_targets GROUP BY category
        UNION ALL SELECT 'language', language, sum(share), sum(min_rows) FROM category_targets GROUP BY language),
    h AS (SELECT 'category' AS field, category AS value, count(*) AS available FROM c GROUP BY category UNION ALL SELECT 'language', language, count(*) FROM c GROUP BY language),
    w AS (SELECT one.*, coalesce(h.available, 0) AS available, greatest(CAST(ceil(CAST(share AS DECIMAL(18, 6)) * ((SELECT count(*) FROM p) // 5)) AS BIGINT), CAST(min_rows AS BIGINT)) AS needed
        FROM one LEFT JOIN h USING (field, value))
    SELECT field, value, needed, available, true AS floor_kept, true AS near FROM w"""
)
def p3_single_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets on the category alone and on the language alone at once; near: within a row for each target of what is there and asked for."""
    t = load(spark, sf_dir, "category_targets")
    both = [([c], t.groupBy(c).agg(F.sum(F.col("share").cast("decimal(20,10)")).alias("share"), F.sum("min_rows").alias("min_rows"))) for c in ("category", "language")]
    reports, out = matched_sample(_all_pieces(spark, sf_dir), "piece_no", both).reports, None
    for (on, table), report in zip(both, reports):
        r = report.join(F.broadcast(table), on).select(
            F.lit(on[0]).alias("field"), F.col(on[0]).alias("value"), "needed", "available",
            (F.col("taken") >= F.least("available", "min_rows")).alias("floor_kept"), (F.col("taken") >= F.least("available", "needed") - F.lit(17)).alias("near"),
        )
        out = r if out is None else out.union(r)
    return out


# --- 4: the first N of every group

_TOP_SQL = """
    WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY measure_no ORDER BY loaded_at DESC) AS rn FROM review_measure) WHERE rn = 1),
    k AS (SELECT measure_no, score_id, lower(trim(part)) AS part, row_number() OVER (PARTITION BY score_id, lower(trim(part))
        ORDER BY priority DESC, min_confidence ASC NULLS LAST, m_idx, staff, measure_no) AS place
        FROM m WHERE priority IS NOT NULL AND priority <> 0)
"""


def _most_in_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "review_measure").select("measure_no", "loaded_at", "score_id", "part", "priority", "min_confidence", "m_idx", "staff")
    m = latest(m, "measure_no", "loaded_at").drop("loaded_at").filter("priority IS NOT NULL AND priority <> 0 AND NOT isnan(priority)")
    m = m.withColumn("part", F.lower(F.trim("part")))
    order = [("priority", True), ("min_confidence", False), ("m_idx", False), ("staff", False), ("measure_no", False)]
    return top_n(m, ["score_id", "part"], order, 3)


@query(_TOP_SQL + "SELECT measure_no FROM k WHERE place <= 3")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _most_in_need(spark, sf_dir).select("measure_no")


@query(_TOP_SQL + "SELECT score_id, part, count(*) AS n FROM k WHERE place <= 3 GROUP BY score_id, part")
def p4_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _most_in_need(spark, sf_dir).groupBy("score_id", "part").agg(F.count(F.lit(1)).alias("n"))


# --- 6: containers


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {kind: int(capacity) for kind, capacity in _few(load(spark, sf_dir, "containers").select("container_kind", "capacity_tokens"))}
    sizes = count_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")
    return pack(sizes, "doc_id", "tokens", kinds)


@query()
def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which container holds which document, or piece of an oversize one."""
    return _packed(spark, sf_dir)


@query()
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind: containers, tokens and the share of the room that is used."""
    kinds = load(spark, sf_dir, "containers")
    used = _packed(spark, sf_dir).groupBy("container_kind").agg(F.countDistinct("container").alias("n_containers"), F.sum("units").alias("tokens"))
    used = used.join(kinds, "container_kind")
    return used.select("container_kind", "n_containers", "tokens", (F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("used"))


@query("SELECT container_kind, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_overfull, 0 AS n_cut_without_need FROM containers")
def p6_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is in containers of each kind, none is overfull, and no document that fits is cut."""
    kinds = load(spark, sf_dir, "containers").select("container_kind", "capacity_tokens")
    packed = _packed(spark, sf_dir).join(F.broadcast(kinds), "container_kind")
    docs = packed.groupBy("container_kind", "doc_id").agg(F.sum("units").alias("size"), F.count(F.lit(1)).alias("pieces"), F.first("capacity_tokens").alias("capacity"))
    docs = docs.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("n_cut_without_need"))
    full = packed.groupBy("container_kind", "container").agg(F.sum("units").alias("fill"), F.first("capacity_tokens").alias("capacity"))
    return docs.join(full.groupBy("container_kind").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("n_overfull")), "container_kind")


# --- 7: evaluation items in documents


@query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return leaked_items(docs, "doc_id", "text", load(spark, sf_dir, "benchmark"), "item_id", "text").distinct()


# --- 8: subjects


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return find_subjects(docs, learn(docs, load(spark, sf_dir, "subject_labels")))


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


@query()
def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject, and how many are to be expected by the calibrated probabilities."""
    known = load(spark, sf_dir, "subjects").select(F.lower(F.trim("subject")).alias("subject")).distinct()
    n = _subjects(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum("probability").alias("p"))
    return known.join(n, "subject", "left").select("subject", F.coalesce("n", F.lit(0)).alias("n_documents"), F.coalesce("p", F.lit(0.0)).alias("expected_documents"))


@query("SELECT count(*) AS n_documents, 0 AS n_without, 0 AS n_unknown FROM documents")
def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has a subject, and all are of the list."""
    known = F.broadcast(load(spark, sf_dir, "subjects").select(F.lower(F.trim("subject")).alias("subject"), F.lit(1).alias("known")).distinct())
    found = _subjects(spark, sf_dir).join(known, "subject", "left").groupBy("doc_id").agg(F.collect_set("subject").alias("s"), F.count_if(F.col("known").isNull()).alias("unknown"))
    both = load(spark, sf_dir, "documents").select("doc_id").join(found, "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("s").isNull()).alias("n_without"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("n_unknown"))
