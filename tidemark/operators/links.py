"""Joins between streams, groups and sets.

Range conditions get an equi key: time is cut into buckets, each interval is listed under the buckets that
it touches, and a pair is taken in the first bucket that both touch, so that it comes out once and no
theta join is planned. A hot key is left to the skew handling of adaptive execution, which splits such joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import micros

Names = Sequence[str]


def small(df: DataFrame, rows: int = 100_000, size: int = 32 << 20) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and bytes (as JSON text); else as it is."""
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def overlap_pairs(a: DataFrame, b: DataFrame, on: Names, tolerance: int = 0, bucket: int = 7200) -> DataFrame:
    """Pairs of intervals (a_start, a_end) and (b_start, b_end) with equal `on` that come within `tolerance` seconds, bounds included.

    An open end takes the other end of its interval.
    """
    size, slack = bucket * 1_000_000, tolerance * 1_000_000
    a = a.withColumn("_as", micros(F.coalesce("a_start", "a_end")) - slack).withColumn("_ae", micros(F.coalesce("a_end", "a_start")) + slack)
    b = b.withColumn("_bs", micros(F.coalesce("b_start", "b_end"))).withColumn("_be", micros(F.coalesce("b_end", "b_start")))
    listed = lambda df, s, e: df.filter(f"{s} IS NOT NULL").withColumn("_k", F.explode(F.sequence(F.floor(F.col(s) / size), F.floor(F.col(e) / size))))
    met = listed(a, "_as", "_ae").join(listed(b, "_bs", "_be"), [*on, "_k"])
    first = F.greatest(F.floor(F.col("_as") / size), F.floor(F.col("_bs") / size))
    return met.filter((F.col("_as") <= F.col("_be")) & (F.col("_bs") <= F.col("_ae")) & (F.col("_k") == first)).drop("_as", "_ae", "_bs", "_be", "_k")


def counts_within(points: DataFrame, intervals: DataFrame, on: Names, keep: Names, tolerance: int = 0, block: int = 86_400) -> DataFrame:
    """keep, n: how many points (ts) of equal `on` come within `tolerance` seconds of an interval (b_start, b_end), bounds included, added up by keep.

    Without pairs: an interval holds the points up to its end less those before its start, and both are running counts. They run inside
    blocks of time, and the counts of the blocks before are added.
    """
    slack = tolerance * 1_000_000
    ends = F.array(F.struct((micros("b_start") - slack).alias("x"), F.lit(0).alias("place"), F.lit(-1).alias("sign")), F.struct((micros("b_end") + slack).alias("x"), F.lit(2).alias("place"), F.lit(1).alias("sign")))
    found = points.select(*on, micros("ts").alias("_x"), F.lit(1).alias("_place"), F.lit(0).alias("_sign"))
    asked = intervals.select(*on, *keep, F.explode(ends).alias("_e")).select(*on, *keep, F.col("_e.x").alias("_x"), F.col("_e.place").alias("_place"), F.col("_e.sign").alias("_sign"))
    rows = asked.unionByName(found, allowMissingColumns=True).filter("_x IS NOT NULL").withColumn("_b", F.floor(F.col("_x") / (block * 1_000_000)))
    one = F.col("_place") == 1
    sums = rows.groupBy(*on, "_b").agg(F.count_if(one).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(one.cast("long")).over(Window.partitionBy(*on, "_b").orderBy("_x", "_place").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_i", inside).filter("_sign <> 0").join(sums.select(*on, "_b", before.alias("_before")), [*on, "_b"])
    return joined.groupBy(*keep).agg(F.sum(F.col("_sign") * (F.col("_before") + F.col("_i"))).alias("n"))


def earliest_near(points: DataFrame, intervals: DataFrame, on: Names, keep: Names, ties: Names, tolerance: int = 0, block: int = 7200) -> DataFrame:
    """Each point's keep and first: struct(b_start, ties) of the earliest interval (b_start, b_end) of equal `on` within `tolerance` seconds of it (ts), bounds included.

    Without pairs: of all intervals that end late enough the earliest is near if any is, and it is a running minimum from the latest end on. It runs
    inside blocks of time, and the minimum of the later blocks is added.
    """
    slack = tolerance * 1_000_000
    asked = points.select(*on, *keep, (micros("ts") - slack).alias("_x"), (micros("ts") + slack).alias("_until"), F.lit(1).alias("_place"))
    ended = intervals.select(*on, micros("b_end").alias("_x"), F.lit(0).alias("_place"), F.struct("b_start", *ties).alias("first"))
    rows = asked.unionByName(ended, allowMissingColumns=True).filter("_x IS NOT NULL").withColumn("_b", F.floor(F.col("_x") / (block * 1_000_000)))
    least = rows.groupBy(*on, "_b").agg(F.min("first").alias("_m"))
    later = F.min("_m").over(Window.partitionBy(*on).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
    inside = F.min("first").over(Window.partitionBy(*on, "_b").orderBy(F.desc("_x"), "_place").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_i", inside).filter("_place = 1").join(least.select(*on, "_b", later.alias("_later")), [*on, "_b"])
    return joined.select(*keep, "_until", F.least("_later", "_i").alias("first")).filter(micros(F.col("first.b_start")) <= F.col("_until")).drop("_until")


def time_range(df: DataFrame, choices: Sequence[tuple[str, str]]) -> DataFrame:
    """range_start and range_end of the first pair of columns that has a value; a missing end takes the other."""
    pair = [F.when(F.col(s).isNotNull() | F.col(e).isNotNull(), F.struct(F.coalesce(s, e).alias("s"), F.coalesce(e, s).alias("e"))) for s, e in choices]
    return df.withColumn("_r", F.coalesce(*pair)).select("*", F.col("_r.s").alias("range_start"), F.col("_r.e").alias("range_end")).drop("_r")


def ranked_links(rules: Sequence[tuple[str, float]], found: Sequence[tuple[DataFrame, Column]], pair: Names) -> DataFrame:
    """One link for each pair: the first rule that gives it wins, with the rule's confidence.

    rules: (name, confidence) in order; found: rows of pairs, each with the place of its rule, so that rules that look at the same
    pairs share one pass over them.
    """
    table = F.array(*[F.struct(F.lit(n).alias("link_type"), F.lit(float(c)).alias("confidence")) for n, c in rules])
    out = None
    for rows, place in found:
        part = rows.select(*pair, place.cast("int").alias("_rank"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(*pair).agg(F.min("_rank").alias("_rank")).select(*pair, F.get(table, F.col("_rank")).alias("_b"))
    return best.select(*pair, "_b.link_type", "_b.confidence")


def first_group(links: DataFrame, item: Names, group_order: Sequence[Column]) -> DataFrame:
    """Each item with the first group in order that links to it: groups have no capacity, so no loop is needed."""
    w = Window.partitionBy(*item).orderBy(*group_order)
    return links.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def orphans(items: DataFrame, links: DataFrame, item: Names) -> DataFrame:
    """Items that nothing links to."""
    return items.join(links.select(*item).distinct(), list(item), "left_anti")


def launches(children: DataFrame, parents: DataFrame, on: Names, before: int = 300, after: int = 5, bucket: int = 600) -> DataFrame:
    """As-of join: a child's launch is a parent event from `before` seconds before it to `after` seconds after, bounds included.

    children: child_id, child_ts; parents: parent_id, parent_ts. One candidate is high, more are medium, none is low. Of several
    the latest wins; where both sides have a cwd, one with the child's own cwd comes first.
    """
    a = children.withColumn("a_start", micros("child_ts") - before * 1_000_000).withColumn("a_end", micros("child_ts") + after * 1_000_000)
    a = a.withColumn("a_start", F.timestamp_micros("a_start")).withColumn("a_end", F.timestamp_micros("a_end"))
    b = parents.withColumn("b_start", F.col("parent_ts")).withColumn("b_end", F.col("parent_ts"))
    met = overlap_pairs(a, b, on, 0, bucket)
    same = F.coalesce(F.col("child_cwd") == F.col("parent_cwd"), F.lit(False)) if {"child_cwd", "parent_cwd"} <= set(met.columns) else F.lit(False)
    rank = F.struct(same.alias("same"), "parent_ts", "parent_id")
    best = met.groupBy("child_id").agg(F.count_distinct("parent_id").alias("candidates"), F.max_by("parent_id", rank).alias("parent_id"))
    all_rows = children.select("child_id").join(best, "child_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return all_rows.withColumn("confidence", F.when(F.col("candidates") == 0, "low").when(F.col("candidates") == 1, "high").otherwise("medium"))


def sibling_pairs(df: DataFrame, parent: Names, item: str) -> DataFrame:
    """Pairs of items under one parent, smaller item first."""
    a, b = df.select(*parent, F.col(item).alias("a_id")).distinct(), df.select(*parent, F.col(item).alias("b_id")).distinct()
    return a.join(b, list(parent)).filter("a_id < b_id")


def shared_members(df: DataFrame, by: Names, item: str, member: str) -> DataFrame:
    """Pairs of items (smaller first) with the number of members both hold: explode, equi join, count."""
    rows = df.select(*by, item, member).distinct()
    a, b = rows.withColumnRenamed(item, "a_id"), rows.withColumnRenamed(item, "b_id")
    return a.join(b, [*by, member]).filter("a_id < b_id").groupBy(*by, "a_id", "b_id").agg(F.count("*").alias("n_shared"))


def returned(dispatches: DataFrame, returns: DataFrame, on: Names) -> DataFrame:
    """Dispatches with their first return at a later position. Columns: d_idx and r_idx."""
    met = dispatches.join(returns, list(on)).filter("r_idx > d_idx")
    return met.groupBy(*on, "d_idx").agg(F.min("r_idx").alias("r_idx"))


def mentions(texts: DataFrame, numbers: DataFrame, text: str, number: str) -> DataFrame:
    """Rows whose text holds '#' and the number, as a substring: #1 is found in #12 too.

    Every '#digits' of a text is listed with all its beginnings, which makes the substring test an equi join.
    """
    found = F.regexp_extract_all(F.col(text), F.lit("#([0-9]+)"), 1)
    starts = F.flatten(F.transform(found, lambda d: F.transform(F.sequence(F.lit(1), F.length(d)), lambda n: F.substring(d, F.lit(1), n))))
    listed = texts.withColumn("_m", F.explode(F.array_distinct(starts)))
    return listed.join(numbers.withColumn("_m", F.col(number).cast("string")), "_m").drop("_m")


def one_per_key(df: DataFrame, key: Names, priority: Sequence[Column]) -> DataFrame:
    """Of rows that share a key the one of the best priority."""
    return first_group(df, key, priority)


def ancestors(path: Column, sep: str = "/") -> Column:
    """array of struct(depth, path) of a path's proper ancestors, nearest first."""
    parts = F.split(path, sep)
    depth = F.size(parts)
    return F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda i: F.struct(i.alias("distance"), F.array_join(F.slice(parts, F.lit(1), depth - i), sep).alias("path")))).otherwise(F.expr("cast(array() as array<struct<distance:int,path:string>>)"))


def nearest_ancestor(df: DataFrame, known: DataFrame, path: str, key: str, value: str) -> DataFrame:
    """Each row with the value of its nearest known ancestor path; rows without one are left out. known: path, and the value."""
    rows = df.select(key, F.explode(ancestors(F.col(path))).alias("a")).select(key, "a.distance", F.col("a.path").alias("path"))
    return rows.join(known.select("path", value), "path").groupBy(key).agg(F.min_by(value, "distance").alias(value), F.min("distance").alias("distance"))


def nearest_sibling(df: DataFrame, known: DataFrame, path: str, key: str, value: str) -> DataFrame:
    """Each row with the value of a known sibling whose name begins its own up to a dash, a dot or an underscore; the longest such name wins.

    A name is listed under its beginnings at those marks, which makes the prefix test an equi join. known: path, and the value.
    """
    parts = F.split(F.col(path), "/")
    folder, name = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), F.element_at(parts, -1)
    marks = F.filter(F.sequence(F.lit(2), F.length(name)), lambda i: F.substring(name, i, F.lit(1)).isin("-", ".", "_"))
    stems = F.transform(marks, lambda i: F.struct(i.alias("length"), F.concat_ws("/", F.nullif(folder, F.lit("")), F.substring(name, F.lit(1), i - 1)).alias("path")))
    rows = df.filter(F.length(name) > 1).select(key, F.explode(stems).alias("s")).select(key, "s.length", F.col("s.path").alias("path"))
    return rows.join(known.select("path", value), "path").groupBy(key).agg(F.max_by(value, "length").alias(value))


def all_or_nothing(groups: DataFrame, members: DataFrame, group: Names, member: str, facts: DataFrame, amount: str, fallback: DataFrame | None = None) -> DataFrame:
    """Sums facts of a group's members: 'full' only if every member is known, else 'partial' or 'none' without a sum.

    fallback (the group, and the amount) is another source for groups that are not full: 'diff' takes its amount, and where it has
    none the sum of the known members stands ('partial').
    """
    met = groups.join(members, list(group), "left").join(facts.select(member, amount, F.lit(1).alias("_hit")), member, "left")
    sums = met.groupBy(*group).agg(F.count(member).alias("n"), F.count("_hit").alias("hits"), F.sum(amount).alias("total"))
    if fallback is not None:
        full = (F.col("n") > 0) & (F.col("n") == F.col("hits"))
        both = sums.join(fallback.select(*group, F.col(amount).alias("_diff")), list(group), "left")
        source = F.when(full, "full").when(F.col("_diff").isNotNull(), "diff").when(F.col("hits") > 0, "partial").otherwise("none")
        return both.select(*group, "n", "hits", F.when(full, F.col("total")).otherwise(F.coalesce("_diff", "total")).alias("total"), source.alias("source"))
    return sums.select(*group, "n", "hits", F.when((F.col("n") > 0) & (F.col("n") == F.col("hits")), F.col("total")).alias("total"), F.when(F.col("hits") == 0, "none").when(F.col("n") == F.col("hits"), "full").otherwise("partial").alias("source"))
