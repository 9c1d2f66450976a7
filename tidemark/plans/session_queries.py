"""Sessions, decisions, episodes and delegation over the driver tables.

Users stand for sessions (every third one a main session, the others its sub-sessions), signups for dispatches, purchases for returns,
clicks for commits, and orders for decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import codebase as K
from ..operators import episodes as S
from ..operators import links as L
from ..operators import memo
from ..operators import windows as W
from ..session import table
from ..sources import events as E
from .event_queries import BY, ISLANDS, ORDER, events, kind
from .link_queries import LINKS, first_links, link_sides, link_sums, purchases
from .registry import query


@query("SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey % 3 <> 0 AND c_custkey % 4 = 0) AS roots, count(*) FILTER (WHERE c_nationkey % 3 = 0 OR c_custkey % 4 <> 0) AS others FROM customer GROUP BY 1")
def logical_roots(spark: SparkSession, d: str) -> DataFrame:
    """Main sessions and all others: two predicates that complement each other."""
    root = S.logical_root(F.col("c_nationkey") % 3 == 0, F.nullif(F.col("c_custkey") % 4, F.lit(0)))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(root).alias("roots"), F.count_if(~root).alias("others"))


SCOPES = {
    "open": "o_orderstatus = 'O'",
    "strategic": "o_orderpriority = '1-URGENT'",
    "embedded": "o_orderkey % 2 = 0",
    "counter_proposals": "o_orderkey % 4 = 1",
    "proactive_insights": "o_orderkey % 4 = 2",
    "agent_recognized": "o_orderkey % 3 = 0",
    "in_chain": "o_orderkey % 5 <> 0",
    "high_value": "o_orderkey % 6 IN (1, 2, 3)",
    "classified": "o_orderkey % 6 <> 5",
    "with_law": "o_orderkey % 7 <> 0",
    "for_repository": "o_custkey % 10 = 4",
    "for_law": "o_orderkey % 7 = 3",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS scope, count(*) AS n FROM orders WHERE {p}" for n, p in SCOPES.items()))
def decision_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Decisions in each named scope, counted in one pass."""
    key, pick = F.col("o_orderkey"), lambda *xs: F.array(*[F.lit(x) for x in xs])
    rows = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "open").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "strategic").alias("significance"), F.concat(F.lit("r"), F.col("o_custkey") % 10).alias("repository"),
        F.when(key % 2 == 0, 1).alias("embedding"), F.get(pick(None, "counter_proposal", "proactive_insight", "other"), (key % 4).cast("int")).alias("proposal_type"), (key % 3 == 0).alias("agent_recognized"),
        F.nullif(key % 5, F.lit(0)).alias("chain_id"), F.get(pick("option_selection", *S.HIGH_VALUE, "other", None), (key % 6).cast("int")).alias("decision_type"),
        F.when(key % 7 != 0, F.concat(F.lit("law"), key % 7)).alias("law_key"),
    )
    scopes = S.decision_scopes("r4", "law3")
    counts = rows.agg(*[F.count_if(p).alias(n) for n, p in scopes.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("scope"), F.col(n).alias("n")) for n in scopes])).alias("x")).select("x.*")


@query("SELECT o_orderkey FROM orders WHERE trim(CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 5 = 1 THEN 'told' ELSE '' END) <> '' OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 2")
def scorable_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes with any evidence: a text, a list, or a count."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(key % 5 == 0, "  ").when(key % 5 == 1, "told").alias("narrative"), F.when(key % 7 == 0, F.array(F.lit("p"))).when(key % 7 == 1, F.array().cast("array<string>")).alias("plans"), F.when(key % 11 == 2, 3).when(key % 11 == 3, 0).alias("dispatches"))
    return rows.filter(S.scorable(["narrative"], ["plans"], "dispatches")).select("o_orderkey")


@query(
    LINKS
    + """, m AS (SELECT i_user, island, count(*) AS n, sum(CASE r WHEN 0 THEN 1000 WHEN 1 THEN 900 ELSE 500 END) AS s FROM b GROUP BY ALL)
SELECT 'group' AS kind, il.i_user || ':' || il.island::BIGINT AS key, coalesce(((2 * m.s + 10 * m.n) // (20 * m.n)) / 100.0, 0.5)::DOUBLE AS confidence FROM il LEFT JOIN m ON m.i_user = il.i_user AND m.island = il.island
UNION ALL SELECT 'session', event_id::VARCHAR, 0.3 FROM p WHERE event_id NOT IN (SELECT event_id FROM b)"""
)
def episode_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence of the links of each island, and lone purchases."""
    p, il = link_sides(spark, d)
    means = link_sums(p, il).select("i_user", "island", (F.expr("(2 * s + 10 * n) DIV (20 * n)") / 100.0).cast("double").alias("confidence"))
    lone = p.join(first_links(p, il).select("event_id"), "event_id", "left_anti")
    return S.confidences(il, means, lone, ["i_user", "island"], ["event_id"])


TYPES = {"signup": "subagent_dispatch", "purchase": "subagent_return", "click": "git_commit", "error": "error_encountered", "view": "file_read"}
#: Sessions, their events and what they shipped, in SQL.
DELEGATION = """WITH x AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_type AS type, props AS tool, value FROM events),
s AS (SELECT user_id AS session, user_id % 3 <> 0 AS is_sub, CASE WHEN user_id % 3 <> 0 AND user_id % 7 <> 0 THEN user_id - user_id % 3 END AS parent, bool_or(event_type = 'purchase' AND value > 95) AS shipped,
  CASE WHEN user_id % 5 = 0 AND user_id > 5 THEN user_id - 5 END AS launched_by, CASE user_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'low_quality' WHEN 2 THEN 'failed' END AS narrative FROM events GROUP BY user_id),
d AS (SELECT DISTINCT a.session FROM x a JOIN x b ON a.session = b.session AND a.tool = b.tool AND b.idx > a.idx WHERE a.type = 'signup' AND b.type = 'purchase'),
r AS (SELECT session, min(idx) FILTER (WHERE type = 'purchase') AS first_return, max(idx) FILTER (WHERE type = 'click') AS last_commit FROM x GROUP BY 1),
{own} g AS (SELECT d.session FROM d JOIN r USING (session) {only} WHERE r.last_commit > r.first_return OR d.session IN (SELECT parent FROM s WHERE shipped AND parent IS NOT NULL)) """


def delegation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events of sessions (session, idx, type, tool_use_id), and the sessions."""
    rows = W.event_index(events(spark, d, "event_type", "props"), BY, ORDER)
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    said = rows.select(F.col("user_id").alias("session"), "idx", F.element_at(names, F.col("event_type")).alias("type"), F.col("props").alias("tool_use_id"))
    u = F.col("session")
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.bool_or(kind("purchase") & (F.col("value") > 95)).alias("shipped"))
    sessions = users.select(
        "session", (u % 3 != 0).alias("is_subagent"), F.when((u % 3 != 0) & (u % 7 != 0), u - u % 3).alias("parent"), "shipped",
        F.when((u % 5 == 0) & (u > 5), u - 5).alias("launched_by"), F.get(F.array(F.lit("complete"), F.lit("low_quality"), F.lit("failed")), (u % 4).cast("int")).alias("narrative"),
    )
    return said, sessions


@query(DELEGATION.format(own="", only="") + "SELECT session FROM g")
def committed_returns(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose dispatches came back, and that or whose child shipped."""
    said, sessions = delegation(spark, d)
    return S.committed_returns(said, sessions.filter("parent IS NOT NULL").select("parent", "shipped"))


@query(
    DELEGATION.format(own="", only="")
    + """, n AS (SELECT session, session % 10 AS tenth, count(*) FILTER (WHERE type = 'signup') AS c FROM x GROUP BY ALL),
t AS (SELECT tenth, sum(c)::BIGINT AS dispatches, count(*) FILTER (WHERE c > 0) AS k, count(*) FILTER (WHERE c > 0 AND session IN (SELECT session FROM g)) AS ok FROM n GROUP BY 1)
SELECT tenth, dispatches, CASE WHEN k > 0 THEN ((200 * ok + k) // (2 * k))::BIGINT END AS percent FROM t"""
)
def dispatch_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Dispatches, and the share of dispatching sessions whose work was committed, by tenth of users."""
    said, sessions = delegation(spark, d)
    found = S.dispatch_ratio(said.withColumn("tenth", F.col("session") % 10), sessions.filter("parent IS NOT NULL").select("parent", "shipped"), ["tenth"])
    return found.select("tenth", "dispatches", F.round(F.col("ratio") * 100).cast("long").alias("percent"))


@query(
    DELEGATION.format(own="m AS (SELECT session FROM s WHERE NOT is_sub),", only="JOIN m USING (session)")
    + """, e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
i AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND epoch_us(ts) - epoch_us(prev) > 900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e),
w AS (SELECT user_id AS session, min(ts) AS a, max(ts) AS z FROM i GROUP BY user_id, island),
k AS (SELECT session, parent, shipped FROM s WHERE parent IS NOT NULL),
v AS (SELECT w.*, parent FROM w JOIN k USING (session) WHERE shipped),
q AS (SELECT DISTINCT user_id AS session, props FROM events WHERE event_type = 'purchase' AND value > 90),
f AS (SELECT s.* FROM s JOIN m ON m.session = s.launched_by WHERE narrative IN ('complete', 'low_quality'))
SELECT (SELECT count(*) FROM g) AS dispatch_with_committed_return_count,
  (SELECT count(*) FROM (SELECT DISTINCT a.session, b.session FROM v a JOIN v b ON a.parent = b.parent AND a.session < b.session AND a.a <= b.z AND b.a <= a.z)) AS concurrent_pairs_with_ships_count,
  (SELECT count(*) FROM (SELECT DISTINCT a.session, b.session FROM q a JOIN q b ON a.props = b.props AND a.session < b.session JOIN k ka ON ka.session = a.session JOIN k kb ON kb.session = b.session AND ka.parent = kb.parent)) AS review_separation_count,
  (SELECT count(*) FROM s WHERE is_sub AND parent IS NULL) AS orphan_subagent_count, (SELECT count(*) FROM s WHERE is_sub) AS subagent_count,
  (SELECT count(*) FROM x JOIN m USING (session) WHERE type = 'signup') AS dispatch_count, (SELECT count(*) FROM x JOIN m USING (session) WHERE type = 'purchase') AS return_count,
  (SELECT count(DISTINCT launched_by) FROM f) AS cross_tool_delegation_count, (SELECT count(*) FROM f) AS cross_tool_child_completed_count"""
)
def parallelism(spark: SparkSession, d: str) -> DataFrame:
    """Nine counts of delegated work in one row."""
    said, sessions = delegation(spark, d)
    windows = W.gap_sessions(events(spark, d), BY, "ts", ORDER, 900).select(F.col("user_id").alias("session"), "start_ts", "end_ts")
    groups = table(spark, d, "events").filter(kind("purchase") & (F.col("value") > 90)).select(F.col("user_id").alias("session"), F.col("props").alias("group")).distinct()
    return S.parallelism(said, sessions, windows, groups)


@query("SELECT event_type, count(*) FILTER (WHERE value < 30) AS hits, count(*) FILTER (WHERE value >= 30) AS misses, round(100.0 * count(*) FILTER (WHERE value < 30) / count(*))::INT AS percent FROM events GROUP BY ROLLUP (event_type)")
def cache_counters(spark: SparkSession, d: str) -> DataFrame:
    """Cache hits and misses of each service and of all."""
    return S.cache_counters(table(spark, d, "events"), "event_type", F.col("value") < 30)


PHASES = ("complete", "failed", "pending", "extracting", "parsing", "analyzing", "aggregating", "other")


@query(
    f"""WITH u AS (SELECT o_orderkey, list_value({', '.join(repr(x) for x in PHASES)})[(o_orderkey % 8) + 1] AS status, o_custkey % 20 AS done, (o_orderkey // 8) % 21 AS total FROM orders)
SELECT o_orderkey, CASE status WHEN 'complete' THEN 100 WHEN 'failed' THEN 0 WHEN 'pending' THEN 2 WHEN 'extracting' THEN 2 WHEN 'parsing' THEN 10 WHEN 'aggregating' THEN 90
  WHEN 'analyzing' THEN CASE WHEN total = 0 THEN 15 ELSE round(15 + done::DOUBLE / total::DOUBLE * 70) END ELSE CASE WHEN total = 0 THEN 0 ELSE round(done::DOUBLE / total::DOUBLE * 100) END END::INT AS percent FROM u"""
)
def upload_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress in percent by phase."""
    key = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, PHASES)), (key % 8).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", S.progress_percentage(status, F.col("o_custkey") % 20, F.floor(key / 8) % 21).alias("percent"))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'r' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'local:/w/' || c_nationkey ELSE 'unknown' END AS \"group\", string_agg(c_name, '|' ORDER BY c_name) AS members, count(*) AS dirs, sum(c_custkey % 5)::BIGINT AS sessions FROM customer GROUP BY 1")
def project_groups(spark: SparkSession, d: str) -> DataFrame:
    """Folders grouped by remote, else by place, else as unknown."""
    key = F.col("c_custkey")
    place = lambda prefix: F.concat(F.lit(prefix), F.col("c_nationkey").cast("string"))
    dirs = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.when(key % 3 == 0, place("r")).otherwise("").alias("remote"), F.when(key % 3 == 1, place("/w/")).alias("cwd"), (key % 5).alias("sessions"))
    return S.project_groups(dirs)


@query(
    """WITH c AS (SELECT event_id AS child_id, ts, user_id % 10 AS t, event_id % 3 AS cwd FROM events WHERE event_type = 'signup'), p AS (SELECT event_id AS parent_id, ts, user_id % 10 AS t, event_id % 3 AS cwd FROM events WHERE event_type IN ('click', 'view')),
m AS (SELECT c.child_id, count(p.parent_id) AS candidates, arg_max(p.parent_id, (p.cwd = c.cwd, p.ts, p.parent_id)) FILTER (WHERE p.parent_id IS NOT NULL) AS parent_id FROM c LEFT JOIN p ON c.t = p.t AND p.ts BETWEEN c.ts - INTERVAL 300 SECOND AND c.ts + INTERVAL 5 SECOND GROUP BY c.child_id)
SELECT child_id, candidates, parent_id, CASE WHEN candidates = 0 THEN 'low' WHEN candidates = 1 THEN 'high' ELSE 'medium' END AS confidence FROM m"""
)
def cwd_launch(spark: SparkSession, d: str) -> DataFrame:
    """Launches where a candidate in the child's own folder comes before a later one."""
    rows = events(spark, d, "event_type").withColumn("tenth", F.col("user_id") % 10).withColumn("cwd", F.col("event_id") % 3)
    side = lambda n: [F.col("event_id").alias(f"{n}_id"), F.col("ts").alias(f"{n}_ts"), F.col("cwd").alias(f"{n}_cwd"), "tenth"]
    return L.launches(rows.filter(kind("signup")).select(*side("child")), rows.filter(kind("click") | kind("view")).select(*side("parent")), ["tenth"])


@query(
    """WITH f AS (SELECT p_partkey, p_size FROM part WHERE p_size > 5), m AS (SELECT o_orderkey, o_custkey, l_partkey, f.p_size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN f ON p_partkey = l_partkey),
s AS (SELECT o_orderkey, o_custkey, count(l_partkey) AS n, count(p_size) AS hits, sum(p_size) AS total FROM m GROUP BY ALL)
SELECT o_orderkey, n, hits, CASE WHEN n > 0 AND n = hits THEN total WHEN o_custkey % 3 = 0 THEN o_custkey ELSE total END::BIGINT AS total, CASE WHEN n > 0 AND n = hits THEN 'full' WHEN o_custkey % 3 = 0 THEN 'diff' WHEN hits > 0 THEN 'partial' ELSE 'none' END AS source FROM s"""
)
def diff_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Sums that are whole, else from a second source, else of the known members."""
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    orders = table(spark, d, "orders")
    fallback = orders.filter("o_custkey % 3 = 0").select("o_orderkey", F.col("o_custkey").cast("long").alias("p_size"))
    return L.all_or_nothing(orders.select("o_orderkey"), members, ["o_orderkey"], "p_partkey", table(spark, d, "part").filter("p_size > 5"), "p_size", fallback)


@query(
    """WITH k AS (SELECT DISTINCT 'w/' || split_part(p_name, ' ', 1) AS path, 'r-' || split_part(p_name, ' ', 1) AS remote FROM part WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT 'w/' || replace(p_name, ' ', '-'), 'long-' || p_name FROM part WHERE p_size = 7),
q AS (SELECT p_partkey, 'w/' || replace(p_name, ' ', '-') || '_' || p_partkey AS path FROM part)
SELECT p_partkey, arg_max(remote, length(k.path)) AS remote FROM q JOIN k ON starts_with(q.path, k.path) AND substr(q.path, length(k.path) + 1, 1) IN ('-', '_', '.') GROUP BY 1"""
)
def sibling_stems(spark: SparkSession, d: str) -> DataFrame:
    """Remotes recovered from siblings whose names begin a folder's own."""
    p = table(spark, d, "part")
    first, dashed = F.substring_index("p_name", " ", 1), F.translate("p_name", " ", "-")
    known = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("w/"), first).alias("path"), F.concat(F.lit("r-"), first).alias("remote"))
    known = known.unionAll(p.filter("p_size = 7").select(F.concat(F.lit("w/"), dashed), F.concat(F.lit("long-"), F.col("p_name")))).distinct()
    rows = p.select("p_partkey", F.concat(F.lit("w/"), dashed, F.lit("_"), F.col("p_partkey").cast("string")).alias("path"))
    return L.nearest_sibling(rows, known, "path", "p_partkey", "remote")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN o_orderdate ELSE o_orderdate - INTERVAL 2 DAY END AS range_start, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN o_orderdate WHEN o_orderkey % 4 = 2 THEN o_orderdate - INTERVAL 2 DAY ELSE o_orderdate END AS range_end FROM orders")
def session_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Time ranges from the first source that has one; a missing end takes the other."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    early = F.col("o_orderdate") - F.expr("INTERVAL 2 DAYS")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(key % 4 > 1, early).alias("s1"), F.when(key % 4 == 3, day).alias("e1"), F.when(key % 4 > 0, day).alias("s2"), F.lit(None).cast("timestamp_ntz").alias("e2"))
    return L.time_range(rows, [("s1", "e1"), ("s2", "e2")]).select("o_orderkey", "range_start", "range_end")


MATCHERS = {"numbers": "[0-9]", "accents": "[à-ÿ]", "long_words": "[a-z]{12,}", "ends_with_stop": "[.]$", "two_commas": ",[^,]*,"}


@query("SELECT role, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS {n}" for n, p in MATCHERS.items()) + " FROM conversations GROUP BY 1")
def message_counts(spark: SparkSession, d: str) -> DataFrame:
    """Messages, not occurrences, that each of several matchers finds."""
    return K.message_counts(table(spark, d, "conversations"), ["role"], "text", MATCHERS)


@query("WITH t AS (SELECT conv_id, sum(ceil(length(text) / 4.0)::BIGINT)::BIGINT AS tokens FROM conversations GROUP BY 1) SELECT conv_id, tokens FROM t WHERE tokens >= 200")
def long_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations long enough to be told about."""
    return K.long_enough(table(spark, d, "conversations"), ["conv_id"], "text", 200)


SIGNALS = "WITH x AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'file_edit' WHEN 'view' THEN 'file_create' WHEN 'purchase' THEN 'test_run' WHEN 'error' THEN 'error_encountered' ELSE 'other' END AS type, CASE event_type WHEN 'click' THEN 'src/f' || floor(value)::INT WHEN 'view' THEN 'plans/p' || floor(value / 10)::INT END AS path, floor(value)::INT % 3 AS failed FROM events) "


def signal_rows(spark: SparkSession, d: str) -> DataFrame:
    v = F.floor("value").cast("int")
    path = F.when(kind("click"), F.concat(F.lit("src/f"), v.cast("string"))).when(kind("view"), F.concat(F.lit("plans/p"), F.floor(F.col("value") / 10).cast("int").cast("string")))
    names = {"click": "file_edit", "view": "file_create", "purchase": "test_run", "error": "error_encountered"}
    kinds = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), "event_type"), F.lit("other"))
    return table(spark, d, "events").select("user_id", kinds.alias("type"), path.alias("path"), (v % 3).alias("failed"))


@query(
    SIGNALS
    + """SELECT user_id, count(DISTINCT path) FILTER (WHERE type = 'file_edit') AS files, count(DISTINCT path) FILTER (WHERE type = 'file_create') AS plan_files, count(*) FILTER (WHERE type = 'test_run') AS tests,
  count(*) FILTER (WHERE type = 'test_run' AND failed = 0) AS passes, count(*) FILTER (WHERE type = 'error_encountered') AS errors FROM x GROUP BY 1"""
)
def outcome_signals(spark: SparkSession, d: str) -> DataFrame:
    """Files, plans, tests, passes and errors of each session."""
    return S.outcome_signals(signal_rows(spark, d), ["user_id"]).drop("pass_rate")


@query(SIGNALS + "SELECT user_id AS session, type, count(*) AS n, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM x GROUP BY ALL")
def event_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and the distinct files of each session."""
    found = E.breakdown(signal_rows(spark, d).withColumnRenamed("user_id", "session"))
    return found.select("session", "type", "n", F.when(F.size("files") > 0, F.array_join("files", ",")).alias("files"))


@query("SELECT user_id AS session, count(*) FILTER (WHERE event_type = 'signup') AS dispatches, count(*) FILTER (WHERE event_type = 'purchase') AS returns, count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS errors, coalesce(string_agg(DISTINCT props, ';' ORDER BY props) FILTER (WHERE event_type = 'signup'), '') AS descriptions FROM events GROUP BY 1")
def dispatch_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Dispatches, returns, failed returns and descriptions of each session."""
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    rows = table(spark, d, "events").select(F.col("user_id").alias("session"), F.element_at(names, F.col("event_type")).alias("type"), F.col("props").alias("description"), (F.col("value") > 50).alias("indicates_error"))
    return E.dispatch_metadata(rows).withColumn("descriptions", F.array_join("descriptions", ";"))


@query("SELECT c_nationkey, count(DISTINCT (c_mktsegment, c_custkey % 7)) AS n FROM customer GROUP BY 1")
def distinct_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Distinct items by key, however often they repeat."""
    rows = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", (F.col("c_custkey") % 7).alias("seventh"))
    return A.distinct_counts(rows, ["c_nationkey"], ["c_mktsegment", "seventh"])


@query("WITH c AS (SELECT user_id, (event_id % 5 - 2) * 60 AS m, count(*) AS n, min(event_id) AS f FROM events WHERE event_id % 5 <> 2 GROUP BY ALL HAVING count(*) >= 3) SELECT user_id, arg_min(m, (-n, f)) AS winner, max(n) AS n FROM c GROUP BY user_id")
def offset_mode(spark: SparkSession, d: str) -> DataFrame:
    """Each user's most frequent offset from UTC; zero does not count."""
    rows = table(spark, d, "events").select("user_id", "event_id", ((F.col("event_id") % 5 - 2) * 60).alias("minutes"))
    return A.mode_first_seen(rows, BY, "minutes", "event_id", without=(0,))


@query("SELECT md5(text) AS key, max(CASE WHEN doc_id % 3 = 0 THEN 'old' WHEN doc_id % 3 = 1 THEN 'stale' END) IS NOT DISTINCT FROM 'old' AS was_known, count(*) AS n FROM documents GROUP BY 1")
def memo_ttl(spark: SparkSession, d: str) -> DataFrame:
    """A memo with live and with stale entries: live ones are hits, all others are computed once; hits are refreshed."""
    rows = table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    used = F.when(F.col("old"), F.lit("2024-02-15 00:00:00")).otherwise("2023-12-01 00:00:00").cast("timestamp")
    known = rows.filter("doc_id % 3 < 2").groupBy("key").agg(F.bool_or(F.col("doc_id") % 3 == 0).alias("a"), F.bool_or(F.col("doc_id") % 3 == 1).alias("b"))
    known = known.withColumn("old", F.col("a") & ~F.col("b")).select("key", F.when(F.col("old"), "old").otherwise("stale").alias("value"), used.alias("used_at"))
    results, stored = memo.memoised(rows, known, "key", lambda keys: keys.select("key", F.lit("new").alias("value")), now)
    fresh = stored.filter(F.col("used_at") == now).select("key")  # every key that was asked for is fresh
    return results.join(fresh, "key", "left_semi").groupBy("key").agg((F.max("value") == "old").alias("was_known"), F.count("*").alias("n"))
