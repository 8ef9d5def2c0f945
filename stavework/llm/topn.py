"""The first N rows of every group by simultaneous bisection of an order-preserving code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegralType, TimestampNTZType, TimestampType

from stavework.runtime import drop_table, join_by_key, materialize

#: A round cuts the span of each group into 2 ** BITS pieces.
BITS = 8
#: Stands for null and NaN, which come last.
LAST = (1 << 63) - 1


def _double_code(x: Column) -> Column:
    """Whole numbers in the order of doubles: the bits that IEEE gives the size, with the sign; infinities included."""
    size = F.abs(x)
    # the exponent from the logarithm may be one off; powers of two with whole exponents are exact
    guess = F.greatest(F.least(F.floor(F.log2(size)).cast("int"), F.lit(1023)), F.lit(-1022))
    power = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when((guess < 1023) & (F.pow(F.lit(2.0), F.least(guess + 1, F.lit(1023))) <= size), guess + 1).otherwise(guess)
    power = F.greatest(power, F.lit(-1022))
    normal = (power + 1023).cast("bigint") * F.lit(1 << 52) + ((size / F.pow(F.lit(2.0), power) - 1) * F.lit(float(1 << 52))).cast("bigint")
    tiny = (size * F.lit(2.0**1022) * F.lit(float(1 << 52))).cast("bigint")
    bits = F.when(size < F.lit(2.0**-1022), tiny).when(size > F.lit(1.7976931348623157e308), F.lit(2047 << 52)).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def code(df: DataFrame, order: list[tuple[str, bool]]) -> list[Column]:
    """Words of 64 bits that compared one after the other sort ascending as ``order`` (column, descending) asks.

    Nulls and NaN come last either way; -0 equals 0. Whole numbers, decimals of any precision, floats, booleans, dates
    and timestamps take one word, decimals above 18 digits three. Other types are an error.
    """
    words: list[Column] = []
    for name, down in order:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, (DoubleType, FloatType)):
            c = c.cast("double")
            parts = [F.when(F.isnan(c), F.lit(None)).otherwise(_double_code(c))]
        elif isinstance(kind, DecimalType):
            if kind.precision <= 18:
                parts = [F.expr(f"CAST(CAST(`{name}` AS DECIMAL(38, {kind.scale})) * CAST(1{'0' * kind.scale} AS DECIMAL(19, 0)) AS BIGINT)")]
            else:  # sign and digits, cut from the text: exact at any precision
                digits = f"lpad(replace(CAST(abs(`{name}`) AS STRING), '.', ''), 38, '0')"
                parts = [F.expr(f"sign(`{name}`) * CAST(substring({digits}, {a}, {n}) AS BIGINT)").cast("bigint") for a, n in ((1, 13), (14, 13), (27, 12))]
        elif isinstance(kind, TimestampType):
            parts = [F.unix_micros(c)]
        elif isinstance(kind, TimestampNTZType):
            day, second = F.unix_date(c.cast("date")).cast("bigint"), F.expr(f"CAST(extract(SECOND FROM `{name}`) * 1000000 AS BIGINT)")
            parts = [(day * 1440 + F.hour(c) * 60 + F.minute(c)) * 60_000_000 + second]
        elif isinstance(kind, DateType):
            parts = [F.unix_date(c).cast("bigint")]
        elif isinstance(kind, (IntegralType, BooleanType)):
            parts = [c.cast("bigint")]
        else:
            raise TypeError(f"no order-preserving code for column {name} of type {kind.simpleString()}")
        # ~x turns the order round and can't overflow
        words += [F.coalesce(F.bitwise_not(p) if down else p, F.lit(LAST)) for p in parts]
    return words


def _pick(which: Column, of: list[Column]) -> Column:
    return reduce(lambda rest, k: F.when(which == k, of[k]).otherwise(rest), range(len(of) - 1, -1, -1), F.lit(None).cast("bigint"))


def _state(df: DataFrame, m: int) -> DataFrame:
    """Adds the first word ``w`` in which the rows counted differ, its least value and the shift that cuts it into pieces."""
    w = F.coalesce(*[F.when(F.col(f"lo{k}") < F.col(f"hi{k}"), F.lit(k)) for k in range(m)])
    lo, hi = (_pick(F.col("w"), [F.col(f"{e}{k}") for k in range(m)]) for e in ("lo", "hi"))
    # halves first: a span of 64 bits doesn't overflow
    span = F.shiftright("hi", 1) - F.shiftright("lo", 1)
    shift = F.greatest(F.length(F.bin(span)) + 1 - BITS, F.lit(0))
    return df.withColumn("w", w).withColumn("lo", lo).withColumn("hi", hi).withColumn("shift", shift.cast("int"))


def top_n(df: DataFrame, groups: list[str], order: list[tuple[str, bool]], n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, a list of (column, descending); all columns are kept.

    Rows get a code of whole numbers: the words of ``order``, then the row's number, so that repeated rows are told apart
    and exactly ``n`` stay. All groups are bisected at the same time. A round cuts the span of each group, in the first
    word in which its rows differ, into 2 ** BITS pieces by a shift, counts the rows of each piece with one hash
    aggregate (map-side combine), and finds the piece in which the count passes ``n``. Rows in pieces before it stay, rows
    after it go, and only its own rows are looked at again, with the span they really have. A piece narrows a word by
    BITS - 1 bits at least, so rounds end by themselves. The first round needs no spans of groups: its join with the
    pieces found is the only step that moves all rows, and there hot groups are joined where their rows lie. No group is
    sorted or gathered.

    Defined results: null in a group column is a group of its own; nulls and NaN sort last; fewer than ``n`` rows are
    all kept; among rows equal in every order column any ``n`` are kept; an empty table gives an empty result; without
    group columns the whole table is one group.
    """
    raw = code(df, order)
    m = len(raw) + 1
    words, keys = [f"c{k}" for k in range(m)], [f"g{k}" for k in range(max(1, len(groups)))]
    group_cols = [F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)] or [F.lit(0).alias("g0")]
    wrapped = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *group_cols, *[c.alias(w) for c, w in zip([*raw, F.monotonically_increasing_id()], words)])
    base = materialize(wrapped, "topn")  # the row numbers must stay what they are
    ends = [x for k, c in enumerate(words) for x in (F.min(c).alias(f"lo{k}"), F.max(c).alias(f"hi{k}"))]
    whole = base.agg(F.count(F.lit(1)).alias("cnt"), *ends).first()
    if not whole["cnt"] or n < 1:
        drop_table(base)
        return df.filter(F.lit(False))
    # the first round: one span for all groups
    first = next((k for k in range(m) if whole[f"lo{k}"] < whole[f"hi{k}"]), m - 1)
    shift = max((whole[f"hi{first}"] - whole[f"lo{first}"]).bit_length() - BITS, 0)
    rows = base.select("row", *keys, *words, F.lit(first).alias("w"), F.lit(whole[f"lo{first}"]).alias("lo"), F.lit(shift).alias("shift"), F.lit(n).cast("bigint").alias("need"))
    read, written, kept, total = base, [base], [], whole["cnt"]
    while True:
        word = _pick(F.col("w"), [F.col(c) for c in words])
        piece = _shifted(word, F.col("shift")) - _shifted(F.col("lo"), F.col("shift"))
        rows = rows.withColumn("piece", piece.cast("int"))
        hist = rows.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("cnt"), F.first("need").alias("need"), *ends)
        by_group = Window.partitionBy(*keys)
        upto = by_group.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("cnt").over(upto)).withColumn("of_group", F.sum("cnt").over(by_group))
        # the piece in which the count passes what the group needs; of a smaller group the last
        cut = hist.filter((F.col("upto") - F.col("cnt") < F.col("need")) & ((F.col("upto") >= F.col("need")) | (F.col("upto") == F.col("of_group"))))
        cut = _state(cut.withColumn("left", F.col("need") - F.col("upto") + F.col("cnt")), m)
        cut = cut.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("piece").alias("k_piece"), (F.col("cnt") > F.col("left")).alias("open"), F.col("left").alias("k_need"), "of_group", *[F.col(c).alias(f"k_{c}") for c in ("w", "lo", "shift")])
        cut = materialize(cut, "topn-cut")
        near = join_by_key(rows.drop("w", "lo", "shift", "need"), cut, keys, "of_group", total).filter("piece <= k_piece")
        again = F.col("open") & (F.col("piece") == F.col("k_piece"))
        near = materialize(near.select("row", *keys, *words, again.alias("again"), *[F.col(f"k_{c}").alias(c) for c in ("w", "lo", "shift", "need")]), "topn-near")
        drop_table(cut)
        written.append(near)
        kept.append(near.filter("NOT again").select("row.*"))
        rows = near.filter("again").drop("again")
        if len(written) == 2:
            drop_table(read)  # later rounds read what is near only
        total = rows.count()
        if not total:
            return reduce(DataFrame.unionByName, kept)


def _shifted(x: Column, by: Column) -> Column:
    """x >> by, which ``F.shiftright`` takes as a number only."""
    return F.call_function("shiftright", x, by)
