"""Votes, modes, bag overlaps and other aggregates with explicit rules for ties and nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.operators.windows import running_sum


def bounded_mode(df: DataFrame, keys: list[str], value: str, lo: object, hi: object, name: str = "mode") -> DataFrame:
    """The smallest of the most frequent values within [lo, hi]. A key without such a value gives no row."""
    n = df.filter(F.col(value).between(lo, hi)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))


def vote(df: DataFrame, keys: list[str], value: str, then: Column | None = None, name: str = "winner") -> DataFrame:
    """The most frequent value, of equals that with the largest ``then``; null if still drawn. Nulls don't vote."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    n = n.withColumn("__t", then if then is not None else F.lit(0))
    best = n.withColumn("__r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("__n"), F.desc("__t")))).filter("__r = 1")
    return best.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias(name))


def majority(df: DataFrame, keys: list[str], value: str, order: str, least: int = 2, name: str = "majority") -> DataFrame:
    """The modal value (nulls vote, the first seen wins a draw) if ``least`` vote and it has more than half."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    w = Window.partitionBy(*keys)
    n = n.withColumn("__all", F.sum("__n").over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc("__n"), "__first")))
    top = n.filter("__r = 1")
    return top.select(*keys, F.when((F.col("__all") >= least) & (F.col("__n") * 2 > F.col("__all")), F.col(value)).alias(name))


def reference_part(parts: DataFrame, keys: list[str], part: str, length: str, confidence: str) -> DataFrame:
    """The part that others are aligned to: of the longest length that two parts share, else of the middle length
    (element n div 2 in order), the one of highest mean confidence; the first wins a draw."""
    w = Window.partitionBy(*keys)
    shared = parts.groupBy(*keys, length).agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").groupBy(*keys).agg(F.max(length).alias("__shared"))
    mid = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(length)).alias("l")).select(*keys, F.element_at("l", (F.call_function("div", F.size("l").cast("bigint"), F.lit(2).cast("bigint")) + 1).cast("int")).alias("__mid"))
    d = parts.join(mid, keys).join(shared, keys, "left").filter(F.col(length) == F.coalesce("__shared", "__mid"))
    return d.withColumn("__r", F.row_number().over(w.orderBy(F.desc(F.coalesce(confidence, F.lit(0.0))), part))).filter("__r = 1").select(*keys, part, length)


def others_share(df: DataFrame, column: list[str], flag: str, name: str) -> DataFrame:
    """The share of the *other* rows of the column for which ``flag`` holds; 1.0 where there is no other."""
    w = Window.partitionBy(*column)
    own = F.col(flag).cast("int")
    return df.withColumn(name, F.coalesce((F.sum(own).over(w) - own) / F.nullif(F.count(F.lit(1)).over(w) - 1, F.lit(0)), F.lit(1.0)))


def bag_overlap(a: DataFrame, b: DataFrame, keys: list[str], token: str) -> DataFrame:
    """Per key the size of both bags and of their intersection (sum of the smaller counts). Nulls are tokens."""
    x = a.groupBy(*keys, token).agg(F.count(F.lit(1)).alias("__a"))
    y = b.groupBy(*keys, token).agg(F.count(F.lit(1)).alias("__b"))
    both = x.withColumn("__b", F.lit(0).cast("bigint")).unionByName(y.withColumn("__a", F.lit(0).cast("bigint"))).groupBy(*keys, token).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    return both.groupBy(*keys).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b"), F.sum(F.least("__a", "__b")).alias("n_both"))


def precision_recall(matched: Column, predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where it has no denominator."""
    p = F.coalesce(F.try_divide(matched, predicted), F.lit(0.0))
    r = F.coalesce(F.try_divide(matched, truth), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def claimed(pred: DataFrame, truth: DataFrame, keys: list[str], token: list[str], order: list[str], name: str = "correct") -> DataFrame:
    """Each predicted row claims one identical row of the truth, in order; ``name`` says whether it got one.

    The k-th of equal predictions is right where the truth has at least k: counts of the truth by token are joined, the
    truth's rows are not.
    """
    n = truth.groupBy(*keys, *token).agg(F.count(F.lit(1)).alias("__have"))
    k = F.row_number().over(Window.partitionBy(*keys, *token).orderBy(*order))
    right = n.select(*[F.col(c).alias(f"__t_{c}") for c in (*keys, *token)], "__have")
    cond = None
    for c in (*keys, *token):
        x = F.col(c).eqNullSafe(F.col(f"__t_{c}"))
        cond = x if cond is None else cond & x
    d = pred.withColumn("__k", k).join(right, cond, "left")
    return d.withColumn(name, F.col("__k") <= F.coalesce("__have", F.lit(0))).select(*pred.columns, name)


def overlapping_groups(df: DataFrame, groups: dict[str, Column], aggregates: list[Column]) -> DataFrame:
    """Aggregates over groups that overlap: a row belongs to every group whose name isn't null.

    ``groups`` maps a kind to the column with the row's group of that kind. One pass: the row is exploded, not read again.
    """
    names = F.filter(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}:") if k else F.lit(""), c.cast("string"))) for k, c in groups.items()]), lambda x: x.isNotNull())
    return df.withColumn("grp", F.explode(names)).groupBy("grp").agg(*aggregates)


def numbered_in_order(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The rows of each key numbered from 1 in order of a numeric column; no row is gathered with all of its key."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("bigint")), keys, [order], "__one", name).drop("__one")


def first_seen(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """U4, A10: the distinct values of each key in the order in which they are first seen; nulls are none.

    Each value is aggregated to its first place before any list is made: a list holds distinct values only.
    """
    first = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def sorted_distinct(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The distinct values of each key in their own order; nulls are none."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def merged_stats(parts: DataFrame, keys: list[str], sums: list[str], labels: DataFrame) -> DataFrame:
    """A10: partial statistics added up; ``labels`` as from ``first_seen`` go beside, empty where there are none."""
    total = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return total.join(labels, keys, "left").select(*keys, *sums, *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in labels.columns if c not in keys])
