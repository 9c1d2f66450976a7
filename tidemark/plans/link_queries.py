"""Joins over the driver tables: users' islands of activity, and rows of other users in the same tenth (user_id % 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import links as L
from ..operators import windows as W
from ..session import table
from ..storage import stored
from .event_queries import BY, ISLANDS, ORDER, events, kind
from .registry import query


def island_rows(spark: SparkSession, d: str, seconds: int) -> DataFrame:
    found = W.gap_sessions(events(spark, d), BY, "ts", ORDER, seconds)
    return found.select(F.col("user_id").alias("i_user"), "island", F.col("start_ts").alias("b_start"), F.col("end_ts").alias("b_end"), (F.col("user_id") % 10).alias("tenth"))


def purchases(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d, "event_type", "props").filter(kind("purchase"))
    return rows.select("event_id", "user_id", "ts", (F.col("user_id") % 10).alias("tenth"), F.col("ts").alias("a_start"), F.col("ts").alias("a_end"), F.get_json_object("props", "$.k").cast("int").alias("k"))


ISLAND2 = ISLANDS.format(us=7_200_000_000) + ", il AS (SELECT user_id AS i_user, island, min(ts) AS s, max(ts) AS e FROM i GROUP BY user_id, island), p AS (SELECT event_id, user_id, ts, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'purchase')"
NEAR = "p.user_id % 10 = il.i_user % 10 AND p.ts - INTERVAL 1 HOUR <= il.e AND il.s <= p.ts + INTERVAL 1 HOUR"


@query(ISLAND2 + f"SELECT event_id, i_user, island::BIGINT AS island FROM p JOIN il ON {NEAR} AND p.user_id <> il.i_user")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within an hour of another user's island of activity."""
    return L.overlap_pairs(purchases(spark, d), island_rows(spark, d, 7200), ["tenth"], 3600).filter("user_id <> i_user").select("event_id", "i_user", "island")


LINKS = ISLAND2 + f""", l AS (
  SELECT event_id, i_user, island, 0 AS r FROM p JOIN il ON p.user_id = il.i_user AND p.ts BETWEEN il.s AND il.e
  UNION ALL SELECT p.event_id, il.i_user, il.island, 1 FROM p JOIN (SELECT DISTINCT user_id, island, cast(json_extract_string(props, '$.k') AS INT) AS k, user_id % 10 AS t FROM i WHERE event_type = 'signup') x ON x.k = p.k AND x.t = p.user_id % 10 JOIN il ON il.i_user = x.user_id AND il.island = x.island
  UNION ALL SELECT event_id, i_user, island, 2 FROM p JOIN il ON {NEAR}),
b AS (SELECT event_id, i_user, island::BIGINT AS island, min(r) AS r FROM l GROUP BY ALL) """


RULES = [("inside", 1.0), ("same_key", 0.9), ("overlap", 0.5)]
PAIR = ["event_id", "i_user", "island"]


def link_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Purchases, with several: whether others have their event_id; islands, with ks: the distinct keys of their signups. Both are stored, as they are read many times."""
    p = purchases(spark, d).withColumn("several", F.count("*").over(Window.partitionBy("event_id")) > 1)
    rows = W.islands(events(spark, d, "event_type", "props"), BY, "ts", ORDER, 7200)
    key = F.when(kind("signup"), F.get_json_object("props", "$.k").cast("int"))
    il = rows.groupBy(F.col("user_id").alias("i_user"), "island").agg(F.min("ts").alias("b_start"), F.max("ts").alias("b_end"), F.collect_set(key).alias("ks"))
    return stored(p, "purchases"), stored(il.withColumn("tenth", F.col("i_user") % 10), "islands")


def by_key(il: DataFrame) -> DataFrame:
    """Islands with each of their keys."""
    return il.select("i_user", "island", "tenth", "b_start", "b_end", F.explode("ks").alias("k"))


def link_places(p: DataFrame, il: DataFrame) -> DataFrame:
    """PAIR, several, place: the first rule that holds for a purchase and an island. A pair comes once a purchase's row, so that none is shuffled."""
    inside = F.expr("user_id = i_user AND ts BETWEEN b_start AND b_end")
    near = L.overlap_pairs(p, il, ["tenth"], 3600).select(*PAIR, "several", F.when(inside, 0).when(F.array_contains("ks", F.col("k")), 1).otherwise(2).alias("place"))
    t, hour = W.micros("ts"), 3_600_000_000
    met = F.coalesce((t - hour <= W.micros("b_end")) & (W.micros("b_start") <= t + hour), F.lit(False))
    far = p.join(by_key(il), ["tenth", "k"]).filter(~met)
    return near.unionAll(far.select(*PAIR, "several", F.lit(1).alias("place")))


def priority_links(spark: SparkSession, d: str) -> DataFrame:
    places = link_places(*link_sides(spark, d))
    table = F.array(*[F.struct(F.lit(n).alias("link_type"), F.lit(c).alias("confidence")) for n, c in RULES])
    once = places.filter("NOT several").select(*PAIR, F.get(table, F.col("place")).alias("_b")).select(*PAIR, "_b.link_type", "_b.confidence")
    return once.unionAll(L.ranked_links(RULES, [(places.filter("several"), F.col("place"))], PAIR))


def first_links(p: DataFrame, il: DataFrame) -> DataFrame:
    """event_id, first: struct(b_start, i_user, island) of the earliest island that links to it; what nothing links to is left out."""
    near = L.earliest_near(p, il, ["tenth"], ["event_id"], ["i_user", "island"], 3600)
    least = by_key(il).groupBy("tenth", "k").agg(F.min(F.struct("b_start", "i_user", "island")).alias("first"))
    return near.unionByName(p.join(least, ["tenth", "k"]).select("event_id", "first")).groupBy("event_id").agg(F.min("first").alias("first"))


def link_sums(p: DataFrame, il: DataFrame) -> DataFrame:
    """i_user, island, n: how many purchases link to an island, s: their confidence in thousandths.

    Counted without pairs: near ones (a), of the same user inside (b), of a key (c), and of a key near (d) or inside (e) give n = a + c - d.
    Purchases that share an event_id are one, which only their pairs tell.
    """
    one, several = p.filter("NOT several"), p.filter("several")
    group, keyed = ["i_user", "island"], by_key(il).withColumn("user_id", F.col("i_user"))
    all_of_key = keyed.join(one.groupBy("tenth", "k").agg(F.count("*").alias("n")), ["tenth", "k"])
    near = L.counts_within(one, il, ["tenth"], group, 3600, 7200)
    inside = L.counts_within(one, il.withColumn("user_id", F.col("i_user")), ["user_id"], group)
    near_key = L.counts_within(one, keyed, ["tenth", "k"], group, 3600)
    inside_key = L.counts_within(one, keyed, ["user_id", "k"], group)
    sums = None
    for counts, n, s in [(near, 1, 500), (inside, 0, 500), (all_of_key, 1, 900), (near_key, -1, -500), (inside_key, 0, -400)]:
        part = counts.select(*group, (F.col("n") * n).alias("n"), (F.col("n") * s).alias("s"))
        sums = part if sums is None else sums.unionAll(part)
    weights = F.array(*[F.lit(round(c * 1000)) for _, c in RULES])
    pairs = link_places(several, il).groupBy(*PAIR).agg(F.min("place").alias("place"))
    sums = sums.unionAll(pairs.select(*group, F.lit(1).cast("long").alias("n"), F.get(weights, F.col("place")).cast("long").alias("s")))
    return sums.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > 0")


@query(LINKS + "SELECT event_id, i_user, island, CASE r WHEN 0 THEN 'inside' WHEN 1 THEN 'same_key' ELSE 'overlap' END AS link_type, CASE r WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM b")
def priority_link(spark: SparkSession, d: str) -> DataFrame:
    """Links of purchases to islands by three rules; the first that holds decides."""
    return priority_links(spark, d)


@query(LINKS + "SELECT event_id, arg_min(i_user, (s, i_user, island)) AS i_user, arg_min(island, (s, i_user, island)) AS island FROM b JOIN (SELECT i_user, island::BIGINT AS island, s FROM il) USING (i_user, island) GROUP BY event_id")
def greedy_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase goes to the earliest island that links to it."""
    return first_links(*link_sides(spark, d)).select("event_id", "first.i_user", "first.island")


@query(LINKS + "SELECT i_user, island::BIGINT AS island FROM il WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.i_user = il.i_user AND b.island = il.island)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Islands that no purchase links to."""
    return L.orphans(island_rows(spark, d, 7200), priority_links(spark, d), ["i_user", "island"]).select("i_user", "island")


@query(
    """WITH c AS (SELECT event_id AS child_id, ts, user_id % 10 AS t FROM events WHERE event_type = 'signup'), p AS (SELECT event_id AS parent_id, ts, user_id % 10 AS t FROM events WHERE event_type = 'click'),
m AS (SELECT c.child_id, count(p.parent_id) AS candidates, arg_max(p.parent_id, (p.ts, p.parent_id)) FILTER (WHERE p.parent_id IS NOT NULL) AS parent_id FROM c LEFT JOIN p ON c.t = p.t AND p.ts BETWEEN c.ts - INTERVAL 300 SECOND AND c.ts + INTERVAL 5 SECOND GROUP BY c.child_id)
SELECT child_id, candidates, parent_id, CASE WHEN candidates = 0 THEN 'low' WHEN candidates = 1 THEN 'high' ELSE 'medium' END AS confidence FROM m"""
)
def asof_launch(spark: SparkSession, d: str) -> DataFrame:
    """The click that launched each signup: from five minutes before to five seconds after, in the same tenth of users."""
    rows = events(spark, d, "event_type").withColumn("tenth", F.col("user_id") % 10)
    children = rows.filter(kind("signup")).select(F.col("event_id").alias("child_id"), F.col("ts").alias("child_ts"), "tenth")
    parents = rows.filter(kind("click")).select(F.col("event_id").alias("parent_id"), F.col("ts").alias("parent_ts"), "tenth")
    return L.launches(children, parents, ["tenth"])


@query(
    ISLANDS.format(us=43_200_000_000)
    + """, il AS (SELECT user_id, island, min(ts) AS s, max(ts) AS e FROM i GROUP BY user_id, island)
SELECT DISTINCT a.user_id AS a_id, a.island::BIGINT AS a_island, b.user_id AS b_id, b.island::BIGINT AS b_island FROM il a JOIN il b ON a.user_id % 10 = b.user_id % 10 AND a.user_id < b.user_id AND a.s <= b.e AND b.s <= a.e"""
)
def sibling_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Islands of different users of one tenth that overlap in time."""
    b = island_rows(spark, d, 43_200).withColumnRenamed("i_user", "b_id").withColumnRenamed("island", "b_island")
    a = island_rows(spark, d, 43_200).select(F.col("i_user").alias("a_id"), F.col("island").alias("a_island"), F.col("b_start").alias("a_start"), F.col("b_end").alias("a_end"), "tenth")
    return L.overlap_pairs(a, b, ["tenth"], 0, 43_200).filter("a_id < b_id").select("a_id", "a_island", "b_id", "b_island")


@query("SELECT a.user_id AS a_id, b.user_id AS b_id, count(*) AS n_shared FROM (SELECT DISTINCT user_id, props FROM events WHERE event_type = 'purchase') a JOIN (SELECT DISTINCT user_id, props FROM events WHERE event_type = 'purchase') b ON a.props = b.props AND a.user_id % 10 = b.user_id % 10 AND a.user_id < b.user_id GROUP BY ALL")
def set_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Users of one tenth whose purchases share properties."""
    rows = events(spark, d, "event_type", "props").filter(kind("purchase")).withColumn("tenth", F.col("user_id") % 10)
    return L.shared_members(rows, ["tenth"], "user_id", "props").select("a_id", "b_id", "n_shared")


@query(
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)
SELECT d.user_id, d.idx::BIGINT AS d_idx, min(r.idx)::BIGINT AS r_idx FROM x d JOIN x r ON d.user_id = r.user_id AND d.props = r.props AND r.idx > d.idx WHERE d.event_type = 'signup' AND r.event_type = 'purchase' GROUP BY d.user_id, d.props, d.idx"""
)
def dispatch_return(spark: SparkSession, d: str) -> DataFrame:
    """Dispatches (signups) with their first return (a purchase of the same user and properties) after them."""
    rows = W.event_index(events(spark, d, "event_type", "props"), BY, ORDER)
    a = rows.filter(kind("signup")).select("user_id", "props", F.col("idx").cast("long").alias("d_idx"))
    b = rows.filter(kind("purchase")).select("user_id", "props", F.col("idx").cast("long").alias("r_idx"))
    return L.returned(a, b, ["user_id", "props"]).select("user_id", "d_idx", "r_idx")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_lines FROM orders WHERE o_orderstatus <> 'O' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Orders without lines, and closed orders with lines."""
    o, keys = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    none = o.join(keys, "o_orderkey", "left_anti").select("o_orderkey", F.lit(False).alias("has_lines"))
    return none.unionAll(o.join(keys, "o_orderkey", "left_semi").filter("o_orderstatus <> 'O'").select("o_orderkey", F.lit(True).alias("has_lines")))


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON contains(s_name, '#0000000' || n_nationkey)")
def number_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose name mentions '#0000000' and a nation's number, also as a beginning of a longer one."""
    numbers = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("0000000"), F.col("n_nationkey").cast("string")).alias("n"))
    return L.mentions(table(spark, d, "supplier").select("s_suppkey", "s_name"), L.small(numbers), "s_name", "n").select("s_suppkey", "n_nationkey")


@query("SELECT md5(text) AS content, arg_min(doc_id, (source, doc_id)) AS doc_id, min(source) AS source FROM documents GROUP BY 1")
def source_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Of documents with the same content the one from the first source."""
    rows = table(spark, d, "documents").select(F.md5("text").alias("content"), "doc_id", "source")
    best = rows.groupBy("content").agg(F.min(F.struct("source", "doc_id")).alias("b"))  # an aggregate, so that hot content combines before the shuffle
    return best.select("content", "b.doc_id", "b.source")


PATHS = "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages)"


@query(
    PATHS
    + """, k AS (SELECT regexp_extract(path, '^[^/]+/[^/]+') AS path, min(page_id) AS first_page FROM p WHERE regexp_extract(path, '^[^/]+/[^/]+') <> '' GROUP BY 1),
a AS (SELECT page_id, unnest(range(1, len(string_split(path, '/')))) AS distance, string_split(path, '/') AS parts FROM p),
x AS (SELECT page_id, distance, array_to_string(parts[1:len(parts) - distance], '/') AS path FROM a)
SELECT page_id, arg_min(first_page, distance) AS first_page, min(distance)::INT AS distance FROM x JOIN k USING (path) GROUP BY page_id"""
)
def ancestor_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the first page of their nearest known ancestor path (host and language)."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/+$", "")
    p = table(spark, d, "pages").select("page_id", path.alias("path"))
    known = p.withColumn("path", F.regexp_extract("path", "^[^/]+/[^/]+", 0)).filter("path <> ''").groupBy("path").agg(F.min("page_id").alias("first_page"))
    return L.nearest_ancestor(p, known, "path", "page_id", "first_page")


@query(
    """WITH f AS (SELECT p_partkey, p_size FROM part WHERE p_size > 5), m AS (SELECT o_orderkey, l_partkey, f.p_size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN f ON p_partkey = l_partkey)
SELECT o_orderkey, count(l_partkey) AS n, count(p_size) AS hits, CASE WHEN count(l_partkey) > 0 AND count(l_partkey) = count(p_size) THEN sum(p_size) END::BIGINT AS total, CASE WHEN count(p_size) = 0 THEN 'none' WHEN count(l_partkey) = count(p_size) THEN 'full' ELSE 'partial' END AS source FROM m GROUP BY 1"""
)
def all_or_nothing(spark: SparkSession, d: str) -> DataFrame:
    """Sum of part sizes of an order, only if every part is known."""
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    return L.all_or_nothing(table(spark, d, "orders").select("o_orderkey"), members, ["o_orderkey"], "p_partkey", table(spark, d, "part").filter("p_size > 5"), "p_size")


@query("SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY ALL")
def join_counts(spark: SparkSession, d: str) -> DataFrame:
    """Filtered counts over a foreign key, the dimension broadcast if it is small."""
    c = table(spark, d, "customer").filter("c_acctbal > 0").select("c_nationkey", "c_mktsegment")
    n = L.small(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return c.join(n, "c_nationkey").groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT n_name, r_name, s_suppkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey")
def left_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Associations loaded with left joins."""
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    return n.join(L.small(r), n.n_regionkey == r.r_regionkey, "left").join(s, s.s_nationkey == n.n_nationkey, "left").select("n_name", "r_name", "s_suppkey")
