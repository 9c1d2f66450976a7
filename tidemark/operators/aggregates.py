"""Aggregations: partial sums combine before the shuffle; nothing is collected but bounded or per-group values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]
#: Parts in which the largest groups are looked for.
PARTS = 64


def nearest_rank(df: DataFrame, by: Names, value: str, shares: dict[str, float]) -> DataFrame:
    """Elements at floor(n * share) of the sorted values (from 0; the last one at most), by counting distinct values.

    Values are counted first, so that a group costs as many rows as it has different values, wherever they repeat.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    placed = counts.withColumn("_n", F.sum("_c").over(w)).withColumn("_end", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = {name: F.least(F.floor(F.col("_n") * s), F.col("_n") - 1) for name, s in shares.items()}
    picked = [F.min(F.when(F.col("_end") > p, F.col(value))).alias(name) for name, p in at.items()]
    return placed.groupBy(*by).agg(F.max("_n").alias("n"), *picked)


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    """a / b rounded half up on decimals; 0 where b is 0 or null."""
    exact = F.try_divide(a.cast("decimal(30,6)"), b.cast("decimal(18,6)"))
    return F.coalesce(F.round(exact, digits), F.lit(0)).cast(f"decimal(20,{digits})")


def floor_div(a: Column, b: Column) -> Column:
    """Division of whole numbers that rounds down, also below zero; the divisor is 1 at least."""
    d = F.greatest(b, F.lit(1))
    return (a - F.pmod(a, d)) / d


def day_span(first: Column, last: Column) -> Column:
    """Days from the first to the last, both included."""
    return F.date_diff(last, first) + 1


def top_and_tail(df: DataFrame, key: str, value: str, n: int = 15, tail: str = "(others)") -> DataFrame:
    """The n largest groups, one row for all others and one for the total. df has a row for each group."""
    # the n largest of each of PARTS parts hold the n largest of all: one pass, and n * PARTS groups with a sum a part are what meets in one place
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    w = Window.partitionBy("_p").orderBy(F.desc(value), key)
    ranked = df.withColumn("_p", part).withColumn("_n", F.row_number().over(w))
    kept = ranked.groupBy("_p").agg(F.sum(value).alias("_s"), F.collect_list(F.when(F.col("_n") <= n, F.struct((-F.col(value)).alias("_v"), F.col(key).alias("_k")))).alias("_t"))
    whole = kept.agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("_s"), F.slice(F.array_sort(F.flatten(F.collect_list("_t"))), 1, n).alias("_t"))
    kind = df.schema[value].dataType.simpleString()
    item = lambda k, v, r: F.struct(k.alias(key), v.cast(kind).alias(value), r.cast("int").alias("rank"))
    shown = F.aggregate("_t", F.lit(0).cast(kind), lambda a, x: (a - x["_v"]).cast(kind))
    rows = F.concat(F.transform("_t", lambda x, i: item(x["_k"], -x["_v"], i + 1)), F.array(item(F.lit(tail), F.col("_s") - shown, F.lit(n + 1)), item(F.lit("(total)"), F.col("_s"), F.lit(n + 2))))
    return whole.select(F.inline(rows))


def mode_or(df: DataFrame, by: Names, value: str, tie: str = "ambiguous") -> DataFrame:
    """The most frequent value of each group; `tie` if several are."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max("n").alias("n"))
    winners = counts.join(best, [*by, "n"]).groupBy(*by, "n").agg(F.count("*").alias("_w"), F.min(value).alias("_v"))
    return winners.select(*by, F.when(F.col("_w") == 1, F.col("_v")).otherwise(F.lit(tie)).alias("winner"), "n")


def mode_first_seen(df: DataFrame, by: Names, value: str, order: str, least: int = 3, without: Sequence = ()) -> DataFrame:
    """The most frequent value with at least `least` rows; the one seen first on ties. Values in `without` do not count."""
    usable = F.col(value).isNotNull() & (~F.col(value).isin(*without) if without else F.lit(True))
    counts = df.filter(usable).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_f")).filter(F.col("n") >= least)
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col("_f"))).alias("winner"), F.max("n").alias("n"))


def labels_of(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules]))


def first_label(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """Name of the first rule that holds."""
    out = None
    for name, hit in rules:
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def ordered_concat(df: DataFrame, by: Names, order: Names, text: str, sep: str) -> DataFrame:
    """Texts of a group joined in order; nulls vanish."""
    items = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, text))))
    return df.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x[text]), sep).alias("joined"), F.count(text).alias("n_parts"))


def top_k(df: DataFrame, by: Names, key: str, k: int, example: str, seq: str) -> DataFrame:
    """The k most frequent keys of each group, ties by key, each with its first example."""
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"), F.min_by(example, seq).alias("example"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("n"), key)
    if not by:
        return counts.orderBy(F.desc("n"), key).limit(k).withColumn("rank", F.row_number().over(w))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_then_distinct(df: DataFrame, by: Names, order: Names, value: str, k: int) -> DataFrame:
    """The first k values in arrival order, then each once: the limit comes before the deduplication."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    items = F.array_sort(F.collect_list(F.struct("_n", value)))  # k items
    return rows.groupBy(*by).agg(F.array_distinct(F.transform(items, lambda x: x[value])).alias("values"))


def map_sum(df: DataFrame, by: Names, column: str) -> DataFrame:
    """Sums maps key by key and keeps the positive sums, a row for each key."""
    return df.select(*by, F.explode(column).alias("key", "value")).groupBy(*by, "key").agg(F.sum("value").alias("value")).filter("value > 0")


def distinct_counts(df: DataFrame, key: Names, item: Names) -> DataFrame:
    """Rows by key after one row of each item is kept: distinct items are counted, however often they repeat."""
    return df.select(*key, *item).distinct().groupBy(*key).agg(F.count("*").alias("n"))


def rate_of(model: Column, rates: Sequence[tuple[str, float, float]], default: tuple[float, float] = (0.0, 0.0)) -> Column:
    """struct(input, output): prices of the first entry (pattern, input, output) whose pattern a model's name holds."""
    pair = lambda a, b: F.struct(F.lit(float(a)).alias("input"), F.lit(float(b)).alias("output"))
    out = None
    for name, a, b in rates:
        hit = F.contains(F.lower(model), F.lit(name))
        out = F.when(hit, pair(a, b)) if out is None else out.when(hit, pair(a, b))
    return pair(*default) if out is None else out.otherwise(pair(*default))


def cost_cents(tokens: Column, price_per_million: Column) -> Column:
    """Whole cents, rounded up, of thousandths of a cent (sum of tokens times price)."""
    return F.ceil(tokens * price_per_million / 10_000)
