"""Content-keyed memo tables, manifests for incremental scans, and key-wise upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = Sequence[str]


def memo_split(rows: DataFrame, memo: DataFrame, key: str, now: Column, ttl_seconds: int = 30 * 86_400) -> tuple[DataFrame, DataFrame]:
    """Rows with a live memo entry (used within the time to live), and the rows to compute. memo: key, value, used_at."""
    live = memo.filter(F.col("used_at") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return rows.join(live, key), rows.join(live.select(key), key, "left_anti")


def memoised(rows: DataFrame, memo: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], now: Column, ttl_seconds: int = 30 * 86_400) -> tuple[DataFrame, DataFrame]:
    """Results of all rows, and the memo to store: hits with a new time of use, and non-empty new values. compute: key and columns to key, value; each key is computed once."""
    hits, misses = memo_split(rows, memo, key, now, ttl_seconds)
    fresh = compute(misses.dropDuplicates([key])).select(key, "value")
    results = hits.select(*rows.columns, "value").unionByName(misses.join(fresh, key, "left").select(*rows.columns, "value"))
    used = hits.select(key, "value").dropDuplicates([key]).unionByName(fresh.filter("value IS NOT NULL")).withColumn("used_at", now)
    old = memo.join(used.select(key), key, "left_anti")
    return results, old.select(key, "value", "used_at").unionByName(used)


def changed(listing: DataFrame, manifest: DataFrame, path: str = "path", version: str = "mtime") -> DataFrame:
    """Files to scan again: new ones, and those whose version differs from the manifest's."""
    return listing.join(manifest.select(path, version), [path, version], "left_anti")


def hits_and_misses(listing: DataFrame, cache: DataFrame, key: Names, value: str, recompute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached values where all key columns match, recomputed ones elsewhere, in one table with `hit`."""
    joined = listing.join(cache.select(*key, value), list(key), "left")
    hit = joined.filter(F.col(value).isNotNull()).withColumn("hit", F.lit(True))
    return hit.unionByName(recompute(joined.filter(F.col(value).isNull()).drop(value)).withColumn("hit", F.lit(False)), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: Names, order: Column | None = None) -> DataFrame:
    """Rows of both by key, the new one wins; of several new ones for a key the greatest in order."""
    if order is not None:
        new = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in key]), order).alias("_r")).select(*key, "_r.*")
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)
