"""Vector similarity in double precision, chains of similar neighbours and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length; null where the sizes differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def chains(df: DataFrame, by: Names, order: str, vector: str, least: float = 0.6, gap: int = 20, length: int = 3) -> DataFrame:
    """Rows of chains: neighbours in order at most `gap` apart with a cosine of at least `least`, in runs of at least `length` rows; position counts from 1."""
    w = Window.partitionBy(*by).orderBy(order)
    close = (F.col(order) - F.lag(order).over(w) <= gap) & (F.coalesce(cosine(F.col(vector), F.lag(vector).over(w)), F.lit(-1.0)) >= least)
    rows = df.withColumn("_new", F.when(close, 0).otherwise(1)).drop(vector)
    rows = rows.withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "chain")
    rows = rows.withColumn("length", F.count("*").over(run)).withColumn("position", F.row_number().over(run.orderBy(order)))
    return rows.filter(F.col("length") >= length).drop("_new")


def chain_edges(rows: DataFrame, by: Names, order: str) -> DataFrame:
    """Consecutive pairs inside each chain."""
    w = Window.partitionBy(*by, "chain").orderBy(order)
    return rows.withColumn("dst", F.lead(order).over(w)).filter("dst IS NOT NULL").select(*by, F.col(order).alias("src"), "dst")


def nearest(df: DataFrame, queries: DataFrame, by: Names, key: str, vector: str, k: int = 3) -> DataFrame:
    """The k rows of greatest cosine in the same group for each query row, ties by key.

    A stated query set meets all rows of its group; each task keeps k rows of a query at most (a top-k window after the join).
    """
    q = queries.select(*by, F.col(key).alias("query_id"), F.col(vector).alias("_q"))
    met = df.join(q, list(by)).filter(F.col(key) != F.col("query_id")).withColumn("cosine", cosine(F.col("_q"), F.col(vector)))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), key)
    return met.select("query_id", key, "cosine").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
