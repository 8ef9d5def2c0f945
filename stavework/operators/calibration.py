"""Confidence: features, logistic fit, isotonic correction, error by bands and bins."""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.operators.windows import equal_bins, folds
from stavework.runtime import join_by_key

#: The bands that reports use. The lower end belongs to a band, the upper to the next.
BANDS = ((0.0, 0.5), (0.5, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.01))


def band(p: Column) -> Column:
    x = F.lit(None).cast("string")
    for lo, hi in BANDS:
        x = F.when((p >= lo) & (p < hi), F.lit(f"{lo}-{min(hi, 1.0)}")).otherwise(x)
    return x


def by_band(df: DataFrame, p: str, ok: str) -> DataFrame:
    """Per band the number of rows, accuracy and mean p. Rows without p form a band of their own, named null; NaN counts as null."""
    x = F.when(~F.isnan(p), F.col(p))
    return df.groupBy(band(x).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(ok).cast("double")).alias("accuracy"), F.avg(x).alias("mean_p"))


def band_error(df: DataFrame, p: str, ok: str) -> DataFrame:
    """One row, the gap between accuracy and mean p weighted by rows, over the bands."""
    b = by_band(df, p, ok).filter("band IS NOT NULL")
    return b.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def bin_error(df: DataFrame, p: str, ok: str, bins: int = 10) -> DataFrame:
    """The same over equal bins with literal edges; 1.0 belongs to the last bin."""
    edges = [F.when(F.col(p) >= k / bins, k) for k in range(bins - 1, -1, -1)]
    b = df.filter(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(F.coalesce(*edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(ok).cast("double")).alias("accuracy"), F.avg(p).alias("mean_p"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def fit_logistic(df: DataFrame, x: str, y: str, l2: float = 0.01) -> tuple[list[float], float]:
    """Weights and bias; penalised on standardised features. Rows with null or NaN in x or y don't count."""
    d = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)))
    m = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=True, maxIter=100, tol=1e-9, featuresCol="__x", labelCol="__y").fit(d.select(array_to_vector(x).alias("__x"), F.col(y).cast("double").alias("__y")))
    return m.coefficients.toArray().tolist(), float(m.intercept)


def logistic(x: Column, weights: list[float], bias: float) -> Column:
    """the score of a feature array, its argument kept within 30."""
    z = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(float(bias)), lambda acc, v: acc + v)
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def piecewise(p: Column, points: list[tuple[float, float]]) -> Column:
    """the monotone map through the points: ends held, the first segment with p <= x1, the left y where x is flat."""
    if not points:
        return p
    x = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        y = F.lit(float(y0)) if x1 == x0 else y0 + (p - x0) / (x1 - x0) * (y1 - y0)
        x = F.when(p <= x1, y).otherwise(x)
    return F.when(p <= points[0][0], F.lit(float(points[0][1]))).otherwise(x)


def pool_adjacent(points: list[tuple[float, float, int]]) -> list[tuple[float, float]]:
    """Blocks of (x mean, y mean, weight) in order of x, neighbours merged while y falls."""
    out: list[list[float]] = []
    for x, y, n in points:
        out.append([x * n, y * n, n])
        while len(out) > 1 and out[-2][1] / out[-2][2] > out[-1][1] / out[-1][2]:
            a = out.pop()
            out[-1] = [u + v for u, v in zip(out[-1], a)]
    return [(sx / n, sy / n) for sx, sy, n in out]


def fit_isotonic(df: DataFrame, p: str, y: str) -> list[tuple[float, float]]:
    """Points of the isotonic correction: rows in order of (p, y) in equal bins, then pooled.

    Only the bins, at most about 80, reach the driver. Rows with null or NaN don't count.
    """
    d = df.filter(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull()).select(F.col(p).alias("p"), F.col(y).cast("double").alias("y"))
    b = equal_bins(d, ["p", "y"]).groupBy("bin").agg(F.avg("p").alias("p"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    return pool_adjacent([(r["p"], r["y"], r["n"]) for r in b.orderBy("bin").collect()])


def out_of_fold(df: DataFrame, x: str, y: str, group: str, k: int = 4) -> DataFrame:
    """The score of each row by the model of the other folds; groups never part. Adds fold and score."""
    from stavework.runtime import materialize

    d = materialize(folds(df, group, k), "folds")
    out = None
    for i in range(k):
        weights, bias = fit_logistic(d.filter(F.col("fold") != i), x, y)
        part = d.filter(F.col("fold") == i).withColumn("score", logistic(F.col(x), weights, bias))
        out = part if out is None else out.unionByName(part)
    return out


# The features of a model file, in order.
FEATURES = (
    "grade", "no_grade", "grade_below_0_5", "grade_below_0_8", "grade_below_0_9", "voice_fills", "rhythm_repaired", "clef_repaired", "out_of_range", "rest", "chord", "grace",
    "tuplet", "altered", "density", "voices", "measure_min_grade", "column_fills", "staff_fill_rate", "staff_mean_grade", "score_fill_rate", "score_mean_grade", "score_located",
)


def write_model(weights: list[float], bias: float, points: list[tuple[float, float]], path: str, trained: dict | None = None) -> None:
    """A model as JSON: features, weights, bias, the points of the isotonic correction, and how it was trained."""
    doc = {"features": FEATURES, "weights": list(map(float, weights)), "bias": float(bias), "calibration": [[float(x), float(y)] for x, y in points], "trained": trained or {}}
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(doc, indent=1) + "\n")


def read_model(path: str) -> tuple[list[float], float, list[tuple[float, float]]] | None:
    """(weights, bias, points) of a model file on the driver; None where it is made for other features."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    if tuple(doc.get("features") or ()) != FEATURES:
        return None
    return [float(w) for w in doc["weights"]], float(doc["bias"]), [(float(x), float(y)) for x, y in doc.get("calibration") or ()]


def apply_model(x: Column, model: tuple[list[float], float, list[tuple[float, float]]]) -> Column:
    """The confidence of a feature array: logistic, then corrected; null where it has another length."""
    weights, bias, points = model
    return F.when(F.size(x) == len(weights), piecewise(logistic(x, weights, bias), points))


def features(events: DataFrame) -> DataFrame:
    """X11, A19, card M: one array of FEATURES for each event.

    ``events`` has the keys score_id, part_ord, staff_no, m_idx, voice_no, and grade, located, fills (of the voice),
    length (of the measure, in quarters, null if unknown), rhythm_repaired, clef_repaired, out_of_range, kind, n_notes,
    grace, tuplet, altered. Shares within a measure are windows; those of staves and scores, which may hold a tenth of all
    events, are aggregated and joined (the score's by ``join_by_key``).
    """
    voice = ["score_id", "part_ord", "staff_no", "m_idx", "voice_no"]
    over = lambda *k: Window.partitionBy(*k)
    b = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    g = F.coalesce("grade", F.lit(0.0))
    # one row of each voice carries its fill, so that voices, not events, are averaged
    d = events.withColumn("__one", F.row_number().over(over(*voice).orderBy(F.lit(1))) == 1).withColumn("__f", F.when(F.col("__one"), b(F.col("fills"))))
    column = over("score_id", "m_idx")
    own = b(F.col("fills"))
    others = F.coalesce((F.sum("__f").over(column) - own) / F.nullif(F.count("__f").over(column) - 1, F.lit(0)), F.lit(1.0))
    staff = d.groupBy(*[F.col(k).alias(f"s_{k}") for k in ("score_id", "part_ord", "staff_no")]).agg(F.avg("__f").alias("s_fill"), F.avg("grade").alias("s_mean"), F.count(F.lit(1)).alias("s_n"))
    score = d.groupBy(F.col("score_id").alias("k_score_id")).agg(F.avg("__f").alias("k_fill"), F.avg("grade").alias("k_mean"), F.avg(b(F.col("located"))).alias("k_located"), F.count(F.lit(1)).alias("k_n"))
    total = score.agg(F.sum("k_n")).first()[0] or 0
    staff = staff.select(*[F.col(f"s_{k}").alias(f"k_{k}") for k in ("score_id", "part_ord", "staff_no")], "s_fill", "s_mean", "s_n")
    d = join_by_key(join_by_key(d, score, ["score_id"], "k_n", total), staff, ["score_id", "part_ord", "staff_no"], "s_n", total)
    mean = F.coalesce("k_mean", F.lit(0.0))
    cols = [
        g, b(F.col("grade").isNull()), b(g < 0.5), b(g < 0.8), b(g < 0.9), own, b(F.col("rhythm_repaired")), b(F.col("clef_repaired")), b(F.col("out_of_range")),
        b(F.col("kind") == "rest"), b(F.col("n_notes") > 1), b(F.col("grace")), b(F.col("tuplet").isNotNull()), b(F.col("altered")),
        F.coalesce(F.count(F.lit(1)).over(over("score_id", "part_ord", "staff_no", "m_idx")) / F.nullif(F.col("length"), F.lit(0.0)), F.lit(4.0)),
        (F.count("__f").over(over("score_id", "part_ord", "staff_no", "m_idx")) - 1).cast("double"),
        F.coalesce(F.min("grade").over(over("score_id", "part_ord", "staff_no", "m_idx")), F.lit(0.0)), others,
        F.coalesce("s_fill", F.lit(0.0)), F.coalesce("s_mean", mean), F.coalesce("k_fill", F.lit(0.0)), mean, F.coalesce("k_located", F.lit(0.0)),
    ]
    return d.withColumn("x", F.array(*cols)).select(*events.columns, "x")


