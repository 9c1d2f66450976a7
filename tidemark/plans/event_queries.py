"""Ordered-event queries over events: a user's rows by (ts, event_id) are one session stream.

error stands for an error, purchase for a commit or a passing test, click for a command, view for a
directive and signup for a proposal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as W
from ..session import table
from .registry import query

BY, ORDER = ["user_id"], ["ts", "event_id"]
OW = "PARTITION BY user_id ORDER BY ts, event_id"
ISLANDS = """
WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
i AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND epoch_us(ts) - epoch_us(prev) > {us} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
"""


def events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", *columns)


def kind(name: str) -> F.Column:
    return F.col("event_type") == name


@query(ISLANDS.format(us=900_000_000) + "SELECT user_id, island::BIGINT AS island, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events FROM i GROUP BY ALL")
def gap_sessions_15m(spark: SparkSession, d: str) -> DataFrame:
    """Sessions cut at gaps of more than 15 minutes."""
    return W.gap_sessions(events(spark, d), BY, "ts", ORDER, 900)


@query(
    """WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, coalesce(sum(gap) FILTER (WHERE gap <= 5400000000), 0)::BIGINT AS active_us, (max(epoch_us(ts)) - min(epoch_us(ts)))::BIGINT AS span_us, count(*) AS n_events,
  (CASE WHEN count(*) < 2 THEN 0 ELSE floor((coalesce(sum(gap) FILTER (WHERE gap <= 5400000000), 0) + 3000000) / 6000000) END)::BIGINT AS active_tenth_minutes FROM g GROUP BY user_id"""
)
def active_minutes_90m(spark: SparkSession, d: str) -> DataFrame:
    """Active time: gaps of at most 90 minutes, in whole microseconds and in tenths of a minute."""
    found = W.active_seconds(events(spark, d), BY, "ts", ORDER, 5400)
    return found.withColumn("active_tenth_minutes", F.when(F.col("n_events") < 2, 0).otherwise(F.expr("(active_us + 3000000) div 6000000")).cast("long"))


CLUSTERS = ISLANDS.format(us=7_200_000_000) + ", s AS (SELECT *, count(*) OVER (PARTITION BY user_id, island) AS size FROM i)"


@query(CLUSTERS + "SELECT user_id, island::BIGINT AS island, count(*) AS size, min(event_id) AS first_event FROM s WHERE size > 1 GROUP BY user_id, island")
def event_clusters_2h(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of rows at most two hours apart."""
    many, _ = W.clusters(events(spark, d), BY, "ts", ORDER, 7200)
    return many.groupBy("user_id", "island").agg(F.count("*").alias("size"), F.min("event_id").alias("first_event"))


@query(CLUSTERS + "SELECT event_id, user_id, ts FROM s WHERE size = 1")
def event_cluster_singles(spark: SparkSession, d: str) -> DataFrame:
    """Rows that no cluster took."""
    return W.clusters(events(spark, d), BY, "ts", ORDER, 7200)[1].select("event_id", "user_id", "ts")


@query(
    f"""WITH x AS (SELECT *, row_number() OVER ({OW}) - 1 AS idx FROM events),
y AS (SELECT *, min(CASE WHEN event_type = 'view' THEN idx END) OVER ({OW} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS response_idx,
  min(CASE WHEN event_type = 'signup' THEN idx END) OVER ({OW} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS other FROM x)
SELECT event_id, user_id, idx::BIGINT AS idx, response_idx::BIGINT AS response_idx FROM y WHERE event_type = 'signup' AND response_idx IS NOT NULL AND (other IS NULL OR response_idx < other)"""
)
def proposal_response_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Proposals and the directive within three rows that answers them."""
    found = W.response_lookahead(events(spark, d, "event_type"), BY, ORDER, kind("signup"), kind("view"))
    return found.select("event_id", "user_id", F.col("idx").cast("long").alias("idx"), F.col("response_idx").cast("long").alias("response_idx"))


@query(
    f"""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER ({OW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  first_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER ({OW} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) AS nearest FROM events"""
)
def nearest_context_5(spark: SparkSession, d: str) -> DataFrame:
    """The nearest command within five rows, earlier ones first."""
    return W.nearest_context(events(spark, d, "event_type"), BY, ORDER, F.when(kind("click"), F.col("event_id"))).select("event_id", "nearest")


@query(
    f"""SELECT event_id, coalesce(bool_or(event_type = 'error') OVER ({OW} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), false) AS error_near,
  coalesce(bool_or(event_type = 'purchase') OVER ({OW} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS purchase_after FROM events"""
)
def window_any_5(spark: SparkSession, d: str) -> DataFrame:
    """Flags of the rows around: five each way, and the five after."""
    near = W.any_near(events(spark, d, "event_type"), BY, ORDER, kind("error"), 5, 5, "error_near")
    return W.any_near(near, BY, ORDER, kind("purchase"), -1, 5, "purchase_after").select("event_id", "error_near", "purchase_after")


@query(
    f"""WITH x AS (SELECT *, row_number() OVER ({OW}) - 1 AS idx FROM events),
y AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN idx END) OVER ({OW} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM x)
SELECT user_id, count(*) AS n_recovered, (2 * median(nxt - idx))::BIGINT AS twice_median FROM y WHERE event_type = 'error' AND nxt IS NOT NULL GROUP BY user_id"""
)
def recovery_distance(spark: SparkSession, d: str) -> DataFrame:
    """Rows from an error to the next success: count and (twice) the median by user."""
    found = W.recovery_distance(events(spark, d, "event_type"), BY, ORDER, kind("error"), kind("purchase"))
    return found.groupBy("user_id").agg(F.count("*").alias("n_recovered"), (2 * F.median("distance")).cast("long").alias("twice_median"))


@query(
    f"""WITH x AS (SELECT *, CASE WHEN event_type = 'click' THEN cast(floor(value / 10) AS INT) END AS cmd FROM events),
y AS (SELECT *, last_value(cmd IGNORE NULLS) OVER ({OW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, list(cmd) OVER ({OW} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nxt FROM x)
SELECT user_id, count(*) AS errors, count(*) FILTER (WHERE list_contains(nxt, prev)) AS retried FROM y WHERE event_type = 'error' AND prev IS NOT NULL GROUP BY user_id"""
)
def error_retry_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Errors whose last command comes again within five rows."""
    command = F.when(kind("click"), F.floor(F.col("value") / 10).cast("int"))
    return W.retry_ratio(events(spark, d, "event_type", "value"), BY, ORDER, kind("error"), command)


@query(
    f"""WITH x AS (SELECT *, row_number() OVER ({OW}) - 1 AS idx FROM events),
f AS (SELECT user_id, min(idx) FILTER (WHERE event_type = 'view') AS first_a, min(idx) FILTER (WHERE event_type = 'click') AS first_b FROM x GROUP BY user_id)
SELECT user_id, first_a::BIGINT AS first_a, first_b::BIGINT AS first_b, first_a IS NOT NULL AND (first_b IS NULL OR first_a < first_b) AS a_first FROM f"""
)
def first_kind_order(spark: SparkSession, d: str) -> DataFrame:
    """Whether a user's first view comes before the first click."""
    found = W.first_before(events(spark, d, "event_type"), BY, ORDER, kind("view"), kind("click"))
    return found.select("user_id", F.col("first_a").cast("long").alias("first_a"), F.col("first_b").cast("long").alias("first_b"), "a_first")


@query(
    f"""WITH x AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({OW} ROWS UNBOUNDED PRECEDING) AS segment FROM events),
a AS (SELECT user_id, segment, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS commits,
  arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('error', 'purchase')) AS last_test FROM x WHERE segment > 0 GROUP BY user_id, segment)
SELECT user_id, segment::BIGINT AS segment, errors, commits, CASE WHEN last_test = 'purchase' THEN 'success' WHEN last_test = 'error' THEN 'failure' WHEN commits > 0 THEN 'committed' ELSE 'unknown' END AS outcome FROM a"""
)
def outcome_segments(spark: SparkSession, d: str) -> DataFrame:
    """What follows each proposal up to the next: counts, and the last test decides the outcome."""
    rows = W.segments(events(spark, d, "event_type"), BY, ORDER, kind("signup"))
    tested = F.when(F.col("event_type").isin("error", "purchase"), F.struct("ts", "event_id"))
    found = rows.groupBy("user_id", "segment").agg(F.count_if(kind("error")).alias("errors"), F.count_if(kind("purchase")).alias("commits"), F.max_by("event_type", tested).alias("last_test"))
    outcome = F.when(F.col("last_test") == "purchase", "success").when(F.col("last_test") == "error", "failure").when(F.col("commits") > 0, "committed").otherwise("unknown")
    return found.select("user_id", "segment", "errors", "commits", outcome.alias("outcome"))


@query(
    f"""WITH x AS (SELECT *, (event_type = 'error')::INT AS f FROM events),
y AS (SELECT *, count(*) OVER w AS n_recent, sum(f) OVER w AS n_failed, sum(1 - f) OVER ({OW} ROWS UNBOUNDED PRECEDING) AS ok FROM x WINDOW w AS ({OW} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, sum(f) OVER (PARTITION BY user_id, ok ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fail_run FROM y)
SELECT event_id, n_recent, n_failed::BIGINT AS n_failed, fail_run::BIGINT AS fail_run, (n_recent = 10 AND n_failed >= 4) OR fail_run >= 3 AS tripped FROM z"""
)
def rolling_failure_rate(spark: SparkSession, d: str) -> DataFrame:
    """Failure rate of the last ten outcomes, tripped at 40 % of a full window or three failures in a row."""
    found = W.rolling_rate(events(spark, d, "event_type"), BY, ORDER, kind("error"), 10, 0.4, 3)
    return found.select("event_id", "n_recent", "n_failed", "fail_run", "tripped")


@query(
    f"""WITH x AS (SELECT *, row_number() OVER ({OW}) AS n FROM events), y AS (SELECT *, n <= 40 OR event_type = 'purchase' AS keep FROM x)
SELECT user_id, count(*) FILTER (WHERE keep) AS n_kept, bool_or(NOT keep) AS truncated FROM y GROUP BY user_id"""
)
def event_cap(spark: SparkSession, d: str) -> DataFrame:
    """A user's first 40 events, structural ones exempt from the cap."""
    return W.capped(events(spark, d, "event_type"), BY, ORDER, 40, kind("purchase")).groupBy("user_id").agg(F.count("*").alias("n_kept"), F.bool_or("truncated").alias("truncated"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_event_type, arg_max(event_type, (ts, event_id)) AS last_event_type FROM events GROUP BY user_id")
def first_last_value(spark: SparkSession, d: str) -> DataFrame:
    """First and last event type of each user, without a sort."""
    return W.first_last(events(spark, d, "event_type"), BY, ORDER, "event_type")


@query(
    f"""WITH x AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER ({OW}) AS n FROM events),
y AS (SELECT *, first_value(t) OVER o AS t0, lag(t) OVER o AS t1 FROM x WINDOW o AS (PARTITION BY user_id ORDER BY n))
SELECT event_id, n::BIGINT AS done, ceil(greatest((t - t0)::DOUBLE / n, (t - t1)::DOUBLE / 1) * greatest(100 - n, 0) * 1.2::DOUBLE / 1000000)::BIGINT AS eta_s FROM y"""
)
def progress_eta(spark: SparkSession, d: str) -> DataFrame:
    """Time left of a run of 100 steps, by the slower of the mean and the latest pace."""
    rows = events(spark, d).withColumn("done", F.row_number().over(W.stream(BY, ORDER)).cast("long"))
    return W.eta(rows, BY, ORDER, "done", "ts", 100).select("event_id", "done", "eta_s")


@query(
    f"""WITH x AS (SELECT *, row_number() OVER ({OW}) - 1 AS idx FROM events),
y AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN idx END IGNORE NULLS) OVER p AS pend, last_value(CASE WHEN event_type IN ('purchase', 'error') THEN idx END IGNORE NULLS) OVER p AS done FROM x WINDOW p AS ({OW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, idx::BIGINT AS idx, pend::BIGINT AS pending_idx FROM y WHERE event_type IN ('purchase', 'error') AND pend IS NOT NULL AND (done IS NULL OR done < pend)"""
)
def result_patch(spark: SparkSession, d: str) -> DataFrame:
    """Each result and the last command that no result has followed yet."""
    found = W.result_patch(events(spark, d, "event_type"), BY, ORDER, kind("click"), F.col("event_type").isin("purchase", "error"))
    return found.select("event_id", F.col("idx").cast("long").alias("idx"), F.col("pending_idx").cast("long").alias("pending_idx"))


@query(
    """WITH x AS (SELECT conv_id, turn, role, cast(ceil(length(text) / 4.0) AS INT) AS tokens FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM x),
r AS (WITH RECURSIVE r(conv_id, n, used, chunk, tokens) AS (
  SELECT conv_id, n, tokens, 0, tokens FROM n WHERE n = 1
  UNION ALL SELECT n.conv_id, n.n, CASE WHEN n.role = 'user' AND r.used > 0 AND r.used + n.tokens > 300 THEN n.tokens ELSE r.used + n.tokens END,
    CASE WHEN n.role = 'user' AND r.used > 0 AND r.used + n.tokens > 300 THEN r.chunk + 1 ELSE r.chunk END, n.tokens FROM r JOIN n ON n.conv_id = r.conv_id AND n.n = r.n + 1) SELECT * FROM r)
SELECT conv_id, chunk::INT AS chunk, count(*) AS n_rows, sum(tokens)::BIGINT AS n_tokens FROM r GROUP BY ALL"""
)
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations cut into chunks of about 300 tokens, only before user turns."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4.0).cast("int").alias("tokens"), (F.col("role") == "user").alias("opens"))
    return W.greedy_chunks(rows, ["conv_id"], ["turn"], "tokens", "opens", 300)


@query(f"SELECT event_id, user_id, ((row_number() OVER ({OW}) - 1) // 20)::BIGINT AS batch FROM events")
def batch_of_20(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 20 events of a user."""
    return W.batches(events(spark, d), BY, ORDER, 20).select("event_id", "user_id", "batch")


@query(
    """WITH x AS (SELECT conv_id, turn, ceil(length(text) / 4.0) AS t FROM conversations),
y AS (SELECT *, greatest(ceil(sum(t) OVER (PARTITION BY conv_id) / 200.0), 1) AS parts, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM x)
SELECT conv_id, turn, floor((k - 1) / ceil(n / parts))::BIGINT AS part FROM y"""
)
def even_split(spark: SparkSession, d: str) -> DataFrame:
    """Conversations cut into ceil(tokens / 200) slices of one length."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4.0).alias("tokens"))
    return W.even_split(rows, ["conv_id"], ["turn"], "tokens", 200).select("conv_id", "turn", "part")


@query("WITH x AS (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS kept FROM documents) SELECT doc_id, source, kept::BIGINT AS kept_size, kept > 60000 AS evicted FROM x")
def cumulative_eviction(spark: SparkSession, d: str) -> DataFrame:
    """Oldest documents of a source to drop until 60,000 characters are left."""
    return W.evict_oldest(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], "doc_id", "n_chars", 60_000, 1000).select("doc_id", "source", "kept_size", "evicted")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_user(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's newest order."""
    return W.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT o_custkey, o_orderpriority, max(o_orderdate) AS o_orderdate FROM orders GROUP BY ALL")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """Newest version in each group, by an aggregate."""
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderdate").alias("o_orderdate"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS prior_o_orderkey, lag(o_orderdate) OVER w AS prior_o_orderdate FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def prior_row(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the customer's one before."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return W.prior(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"]).select("o_orderkey", "prior_o_orderkey", "prior_o_orderdate")
