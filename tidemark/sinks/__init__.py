"""Sinks: nested documents, key-wise upserts, history rings and replay routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.memo import upsert
from ..operators.windows import evict_oldest
from ..storage import file_system

Names = Sequence[str]


def nested(parent: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """One document a parent row: the children of each kind become an array, in the order of their columns."""
    out = parent
    for name, df in children.items():
        rest = [c for c in df.columns if c != key]
        grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        kind = grouped.schema[name].dataType.simpleString()
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {kind})")))
    return out


def write_documents(df: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON object a row."""
    df.write.option("compression", compression).mode("overwrite").json(path)


def versions_of(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table folder, ascending."""
    jpath, files = file_system(spark, path)
    if not files.exists(jpath):
        return []
    names = [x.getPath().getName() for x in files.listStatus(jpath)]
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and files.exists(file_system(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n[1:]) for n in done)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of a table folder; None before the first."""
    found = versions_of(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]:09}") if found else None


def merged(spark: SparkSession, path: str, new: DataFrame, key: Names, keep: int = 2) -> DataFrame:
    """Idempotent upsert into a table folder, which it reads and writes: a second run with the same rows changes nothing.

    Every run writes a version of its own beside the one that it read; a run that dies leaves no complete version. The newest `keep` versions stay,
    so that readers of the one before are not disturbed. Of several new rows of a key one stays, the greatest.
    """
    found, old = versions_of(spark, path), read_table(spark, path)
    rest = [c for c in new.columns if c not in key]
    one = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else new.distinct()
    target = f"{path}/v{(found[-1] if found else 0) + 1:09}"
    (one if old is None else upsert(old, one.select(*old.columns), key)).write.mode("overwrite").parquet(target)
    for n in versions_of(spark, path)[:-keep]:
        jpath, files = file_system(spark, f"{path}/v{n:09}")
        files.delete(jpath, True)
    return spark.read.parquet(target)


def evicted(stash: DataFrame, cap: int, now: Column, ttl_days: int = 14) -> DataFrame:
    """stash: name, stashed_at, bytes. Entries with their fate: expire (older than the time to live), evict (the oldest beyond the cap in bytes), keep."""
    old = F.col("stashed_at") < now - F.make_dt_interval(days=F.lit(ttl_days))
    live = evict_oldest(stash.filter(~old).withColumn("_age", F.unix_micros("stashed_at")).withColumn("_all", F.lit(0)), ["_all"], "_age", "bytes", cap, 3_600_000_000)
    kept = live.select(*stash.columns, F.when(F.col("evicted"), "evict").otherwise("keep").alias("fate"))
    return kept.unionByName(stash.filter(old).withColumn("fate", F.lit("expire")))


def append(df: DataFrame, path: str) -> None:
    """Append-only log."""
    df.write.mode("append").parquet(path)


def history_ring(history: Column, item: Column, keep: int = 3) -> Column:
    """The newest entries of a history with one more at its end."""
    whole = F.concat(history, F.array(item))
    return F.slice(whole, F.greatest(F.size(whole) - keep + 1, F.lit(1)), F.lit(keep))


def versions(writes: DataFrame, by: Names, order: Names) -> DataFrame:
    """Consecutive version numbers of the writes of a file, from 1."""
    return writes.withColumn("version", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def replay_route(entry: Column, status: Column, now: Column, most: int = 5, ttl_days: int = 14) -> Column:
    """What to do with a stashed upload: entry is struct(version, attempts, stashed_at), status the last HTTP status (null: none yet)."""
    return (
        F.when(entry["version"] != 1, "quarantine")
        .when(entry["stashed_at"] < now - F.make_dt_interval(days=F.lit(ttl_days)), "expire")
        .when(status.between(200, 299) | (status == 409), "delete")
        .when(entry["attempts"] >= most, "quarantine")
        .when(status.isNull() | (status == 429) | (status >= 500), "retry")
        .otherwise("quarantine")
    )
