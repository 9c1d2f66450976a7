"""Aggregations, top-k, filters and set operations over the driver tables.

orders and lineitem stand for commits and their files (author o_custkey, date o_orderdate, insertions l_quantity);
conversations for messages; money and sums are whole numbers, so that no order of adding shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import aggregates as A
from ..operators import windows as W
from ..session import table
from .event_queries import BY, OW, events, kind
from .registry import query


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders with insertions (quantity) and deletions (quantity of returned lines)."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("ins"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(0)).alias("dels"), F.count_if(F.col("l_linestatus") == "F").alias("test_files"), F.count("*").alias("files")
    )
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_orderpriority").join(li, "o_orderkey")


COMMITS = """WITH li AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity::BIGINT)::BIGINT AS ins, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS dels, count(*) FILTER (WHERE l_linestatus = 'F') AS test_files, count(*) AS files FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, o_orderstatus, o_orderpriority, ins, dels, test_files, files FROM orders JOIN li USING (o_orderkey)) """


@query(COMMITS + "SELECT coalesce(o_custkey::VARCHAR, 'unknown') AS author, sum(ins)::BIGINT AS insertions, sum(dels)::BIGINT AS deletions, count(*) AS commits FROM c GROUP BY 1")
def author_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Insertions, deletions and commits by author."""
    author = F.coalesce(F.col("o_custkey").cast("string"), F.lit("unknown")).alias("author")
    return commits(spark, d).groupBy(author).agg(F.sum("ins").alias("insertions"), F.sum("dels").alias("deletions"), F.count("*").alias("commits"))


@query(COMMITS + "SELECT day, sum(ins)::BIGINT AS insertions, sum(dels)::BIGINT AS deletions FROM c WHERE day IS NOT NULL GROUP BY 1")
def daily_loc(spark: SparkSession, d: str) -> DataFrame:
    """Lines by day."""
    return commits(spark, d).filter("day IS NOT NULL").groupBy("day").agg(F.sum("ins").alias("insertions"), F.sum("dels").alias("deletions"))


@query(COMMITS + "SELECT o_custkey, arg_max(day, (i, -epoch(day))) AS peak_day, max(i)::BIGINT AS insertions FROM (SELECT o_custkey, day, sum(ins) AS i FROM c GROUP BY ALL) GROUP BY 1")
def peak_day(spark: SparkSession, d: str) -> DataFrame:
    """Each author's day of most insertions, the first on ties."""
    days = commits(spark, d).groupBy("o_custkey", "day").agg(F.sum("ins").alias("i"))
    return days.groupBy("o_custkey").agg(F.max_by("day", F.struct("i", -F.unix_date("day"))).alias("peak_day"), F.max("i").alias("insertions"))


@query(
    COMMITS
    + """, v AS (SELECT o_custkey, count(*) AS commits, sum(ins)::BIGINT AS ins, sum(dels)::BIGINT AS dels, (sum(ins) - 2 * sum(dels))::BIGINT AS net, (date_diff('day', min(day), max(day)) + 1)::BIGINT AS days,
  sum(test_files)::BIGINT AS tf, sum(files)::BIGINT AS f, count(*) FILTER (WHERE o_orderstatus = 'F') AS ships, count(*) FILTER (WHERE o_orderstatus = 'P') AS reverts FROM c GROUP BY 1)
SELECT o_custkey, commits, net, days, floor(net::DOUBLE / greatest(days, 1))::BIGINT AS net_per_day, (tf * 1000 // f)::BIGINT AS test_permille, (CASE WHEN reverts = 0 THEN 0 ELSE ships * 1000 // reverts END)::BIGINT AS ship_revert_permille FROM v"""
)
def velocity(spark: SparkSession, d: str) -> DataFrame:
    """Totals, net per day (floored, also below zero), test share and ship-to-revert ratio of each author."""
    return velocity_of(commits(spark, d), ["o_custkey"])


@query(
    COMMITS
    + """SELECT o_orderpriority, count(*) AS commits, (sum(ins) - 2 * sum(dels))::BIGINT AS net, (date_diff('day', min(day), max(day)) + 1)::BIGINT AS days, floor((sum(ins) - 2 * sum(dels))::DOUBLE / greatest(date_diff('day', min(day), max(day)) + 1, 1))::BIGINT AS net_per_day,
  (sum(test_files) * 1000 // sum(files))::BIGINT AS test_permille, (CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') = 0 THEN 0 ELSE count(*) FILTER (WHERE o_orderstatus = 'F') * 1000 // count(*) FILTER (WHERE o_orderstatus = 'P') END)::BIGINT AS ship_revert_permille
FROM c WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) OR lower(o_orderpriority) = '5-low' GROUP BY 1"""
)
def author_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Velocity of chosen authors' commits: a set of ids, or a name whatever its case."""
    rich = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("_rich"))
    chosen = commits(spark, d).join(rich, "o_custkey", "left").filter(F.col("_rich").isNotNull() | (F.lower("o_orderpriority") == "5-low"))
    return velocity_of(chosen, ["o_orderpriority"])


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def listing(spark: SparkSession, d: str) -> DataFrame:
    """All orders, the newest first: a range exchange and a sort of every partition."""
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


def velocity_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """The block of velocity figures of each group of commits."""
    v = rows.groupBy(*by).agg(
        F.count("*").alias("commits"), (F.sum("ins") - 2 * F.sum("dels")).alias("net"), A.day_span(F.min("day"), F.max("day")).cast("long").alias("days"), F.sum("test_files").alias("tf"), F.sum("files").alias("f"), F.count_if(F.col("o_orderstatus") == "F").alias("ships"), F.count_if(F.col("o_orderstatus") == "P").alias("reverts")
    )
    return v.select(*by, "commits", "net", "days", A.floor_div(F.col("net"), F.col("days")).cast("long").alias("net_per_day"), F.expr("tf * 1000 div f").alias("test_permille"), F.expr("CASE WHEN reverts = 0 THEN 0 ELSE ships * 1000 div reverts END").cast("long").alias("ship_revert_permille"))


@query(
    "WITH v AS (SELECT event_type, list(cents ORDER BY cents) AS l FROM (SELECT event_type, round(value * 100)::BIGINT AS cents FROM events) GROUP BY 1) SELECT event_type, len(l) AS n, l[least(floor(len(l) * 0.5)::BIGINT, len(l) - 1) + 1] AS p50, l[least(floor(len(l) * 0.95)::BIGINT, len(l) - 1) + 1] AS p95 FROM v"
)
def nearest_rank_p95(spark: SparkSession, d: str) -> DataFrame:
    """Upper median and nearest-rank 95th percentile of values (in cents) by event type."""
    rows = table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return A.nearest_rank(rows, ["event_type"], "cents", {"p50": 0.5, "p95": 0.95})


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, (count(*) FILTER (WHERE event_type = 'error') * 1000 // count(*))::BIGINT AS error_permille FROM events GROUP BY 1")
def error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Error rate of each user."""
    return events(spark, d, "event_type").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(kind("error")).alias("errors")).withColumn("error_permille", F.expr("errors * 1000 div total"))


@query(
    """WITH g AS (SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, n_name) AS rank FROM g)
SELECT n_name, n::BIGINT AS n, rank::INT AS rank FROM r WHERE rank <= 15 UNION ALL SELECT '(others)', coalesce(sum(n), 0)::BIGINT, 16 FROM r WHERE rank > 15 UNION ALL SELECT '(total)', coalesce(sum(n), 0)::BIGINT, 17 FROM r"""
)
def rollup_top15_tail(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the 15 largest nations, of the others and of all."""
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    by_customer = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))  # counted before the joins
    g = by_customer.join(c, "c_custkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("k").alias("n"))
    return A.top_and_tail(g, "n_name", "n", 15)


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, max(n) AS n FROM c GROUP BY 1) SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) ELSE 'ambiguous' END AS winner, n FROM c JOIN m USING (user_id, n) GROUP BY user_id, n")
def mode_or_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Each user's most frequent event type, or 'ambiguous'."""
    return A.mode_or(events(spark, d, "event_type"), BY, "event_type")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL HAVING count(*) >= 3) SELECT user_id, arg_min(event_type, (-n, f)) AS winner, max(n) AS n FROM c GROUP BY user_id")
def mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Each user's most frequent event type, the first seen on ties, with a support of three."""
    return A.mode_first_seen(events(spark, d, "event_type"), BY, "event_type", "event_id")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def map_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A histogram map of each user, unfolded again."""
    c = events(spark, d, "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # as many entries as event types
    return maps.select("user_id", F.explode("m").alias("event_type", "n"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS joined, count(*) AS n_parts FROM conversations WHERE role <> 'system' GROUP BY 1")
def ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a conversation as one text."""
    rows = table(spark, d, "conversations").filter("role <> 'system'").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("line"))
    return A.ordered_concat(rows, ["conv_id"], ["turn"], "line", "\n")


@query("SELECT conv_id, ceil(sum(ceil(length(text) / 4.0)::BIGINT * CASE role WHEN 'assistant' THEN 1500 WHEN 'user' THEN 300 ELSE 100 END) / 10000.0)::BIGINT AS cents FROM conversations GROUP BY 1")
def cost_cents(spark: SparkSession, d: str) -> DataFrame:
    """Cost of a conversation from a rate table, rounded up to cents."""
    rates = spark.range(3).select(F.element_at(F.array(F.lit("assistant"), F.lit("user"), F.lit("system")), F.col("id").cast("int") + 1).alias("role"), F.element_at(F.array(F.lit(1500), F.lit(300), F.lit(100)), F.col("id").cast("int") + 1).alias("rate"))
    rows = table(spark, d, "conversations").select("conv_id", "role", F.ceil(F.length("text") / 4.0).alias("tokens")).join(F.broadcast(rates), "role")  # three rows
    return rows.groupBy("conv_id").agg(F.ceil(F.sum(F.col("tokens") * F.col("rate")) / 10_000.0).alias("cents"))


NORM = "trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH l AS (SELECT doc_id, u.line, u.ord AS pos FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, ord)),
k AS (SELECT doc_id, pos, line, {NORM} AS norm FROM l), f AS (SELECT * FROM k WHERE norm <> '' AND len(string_split(norm, ' ')) <= 8),
c AS (SELECT norm, count(*) AS n, arg_min(line, (doc_id, pos)) AS example FROM f GROUP BY norm)
SELECT norm, n, example, row_number() OVER (ORDER BY n DESC, norm)::INT AS rank FROM c ORDER BY n DESC, norm LIMIT 40"""
)
def repeated_prompts_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 40 most frequent short lines, normalised, with their first spelling (a top-k report)."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    norm = F.trim(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " "))
    rows = lines.withColumn("norm", norm).filter("norm <> ''").filter(F.size(F.split("norm", " ")) <= 8).withColumn("seq", F.struct("doc_id", "pos"))
    return A.top_k(rows, [], "norm", 40, "line", "seq")


@query(f"WITH x AS (SELECT user_id, event_type, row_number() OVER ({OW}) AS n FROM events), f AS (SELECT user_id, event_type, min(n) AS n FROM x WHERE n <= 8 GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY n) AS kinds FROM f GROUP BY 1")
def first_k_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Kinds among a user's first eight events, each once, in order of arrival."""
    return A.first_then_distinct(events(spark, d, "event_type"), BY, ["ts", "event_id"], "event_type", 8).select("user_id", F.array_join("values", ",").alias("kinds"))


@query("WITH x AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user' AND length(text) >= 20) SELECT conv_id, string_agg(text, chr(10) ORDER BY n) AS joined, count(*) AS n_parts FROM x WHERE n <= 50 GROUP BY 1")
def first_50_joined(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's first 50 substantive messages as one text."""
    rows = table(spark, d, "conversations").filter("role = 'user' AND length(text) >= 20").select("conv_id", "turn", "text")
    return A.ordered_concat(W.latest(rows, ["conv_id"], [F.col("turn")], 50), ["conv_id"], ["turn"], "text", "\n")


@query(f"WITH x AS (SELECT *, row_number() OVER ({OW}) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events) SELECT event_id, user_id, total FROM x WHERE n <= 10")
def counts_before_cut(spark: SparkSession, d: str) -> DataFrame:
    """A user's first ten events with the count of all."""
    rows = events(spark, d).withColumn("n", F.row_number().over(W.stream(BY, ["ts", "event_id"]))).withColumn("total", F.count("*").over(Window.partitionBy(*BY)))
    return rows.filter("n <= 10").select("event_id", "user_id", "total")


@query("SELECT event_type, arg_max(event_id, (value, -event_id)) AS slowest, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1")
def slowest_latest(spark: SparkSession, d: str) -> DataFrame:
    """Slowest and latest row of each kind without a sort."""
    rows = table(spark, d, "events")
    return rows.groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("slowest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE n = floor(c * 0.95) + 1")
def offset_row(spark: SparkSession, d: str) -> DataFrame:
    """The row at offset floor(0.95 n) of each user by value."""
    rows = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))).withColumn("c", F.count("*").over(Window.partitionBy("user_id")))
    return rows.filter("n = floor(c * 0.95) + 1").select("user_id", "event_id")


@query(COMMITS + "SELECT o_orderkey, ins FROM c ORDER BY coalesce(day, DATE '1970-01-01') DESC, o_orderkey LIMIT 2000")
def newest_cap(spark: SparkSession, d: str) -> DataFrame:
    """The newest 2,000 commits, missing dates as the epoch (the cap is the operator: TakeOrdered, no full sort)."""
    return commits(spark, d).orderBy(F.desc(F.coalesce("day", F.lit("1970-01-01").cast("date"))), "o_orderkey").limit(2000).select("o_orderkey", "ins")


@query("SELECT o_orderpriority, count(*) AS commits, count(DISTINCT o_orderdate::DATE) AS active_days, (count(*) * 1000 // count(DISTINCT o_orderdate::DATE))::BIGINT AS per_day_permille, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS reverts FROM orders GROUP BY 1")
def commit_discipline(spark: SparkSession, d: str) -> DataFrame:
    """Commits, active days and reverts by priority."""
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("commits"), F.count_distinct(F.to_date("o_orderdate")).alias("active_days"), F.count_if(F.col("o_orderstatus") == "P").alias("reverts"))
    return g.withColumn("per_day_permille", F.expr("commits * 1000 div active_days"))


@query("SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest, count(*) FILTER (WHERE n_chars > 3000) AS over_3000, count(*) FILTER (WHERE n_chars > 5000) AS over_5000, (2 * median(n_chars))::BIGINT AS twice_median FROM documents GROUP BY 1")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    """Lengths by language: sums, counts over limits, median."""
    g = table(spark, d, "documents").groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("lang"))
    return g.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") > 3000).alias("over_3000"), F.count_if(F.col("n_chars") > 5000).alias("over_5000"), (2 * F.median("n_chars")).cast("long").alias("twice_median"))


@query("SELECT regexp_extract(url, '\\.([a-z]+)/', 1) AS ext, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, ext LIMIT 20")
def extension_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most frequent endings of hosts (a top-k report)."""
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(20)


@query("SELECT lang, bool_or(contains(text, '@')) AS has_mail, bool_or(contains(text, 'icense')) AS has_license, bool_or(contains(text, '!!')) AS has_shouts, sum(length(text) - length(replace(text, '!', '')))::BIGINT AS bangs FROM documents GROUP BY 1")
def corpus_flags(spark: SparkSession, d: str) -> DataFrame:
    """Existence flags and occurrence counts over a corpus."""
    has = lambda s: F.bool_or(F.contains("text", F.lit(s)))
    return table(spark, d, "documents").groupBy("lang").agg(has("@").alias("has_mail"), has("icense").alias("has_license"), has("!!").alias("has_shouts"), F.sum(F.regexp_count("text", F.lit("!"))).cast("long").alias("bangs"))


@query("SELECT user_id, k, s::BIGINT AS value FROM (SELECT user_id, event_type AS k, sum(round(value)::BIGINT - 40) AS s FROM events GROUP BY ALL) WHERE s > 0")
def map_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sum of signal maps key by key, positives kept."""
    rows = table(spark, d, "events").select("user_id", F.create_map("event_type", F.round("value").cast("long") - 40).alias("m"))
    return A.map_sum(rows, ["user_id"], "m").withColumnRenamed("key", "k")


@query("SELECT conv_id, string_agg(DISTINCT role, ' + ' ORDER BY role) AS label, count(*) AS n, count(DISTINCT role) AS kinds, (count(*) FILTER (WHERE role = 'assistant') * 100 // count(*))::BIGINT AS share FROM conversations GROUP BY 1")
def label_join(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sorted labels joined, and shares, by conversation."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), " + ").alias("label"), F.count("*").alias("n"), F.count_distinct("role").alias("kinds"), F.count_if(F.col("role") == "assistant").alias("_a"))
    return g.withColumn("share", F.expr("_a * 100 div n")).drop("_a")


@query("SELECT user_id, count(*) AS messages, sum(length(props))::BIGINT AS chars, count(DISTINCT event_type) AS tools, bool_or(event_type = 'error') AS any_error, (sum(length(props)) // count(*))::BIGINT AS avg_chars FROM events GROUP BY 1")
def session_signals(spark: SparkSession, d: str) -> DataFrame:
    """Quantitative signals of a session in one pass."""
    g = events(spark, d, "event_type", "props").groupBy("user_id").agg(F.count("*").alias("messages"), F.sum(F.length("props")).alias("chars"), F.count_distinct("event_type").alias("tools"), F.bool_or(kind("error")).alias("any_error"))
    return g.withColumn("avg_chars", F.expr("chars div messages"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') AND c_mktsegment IS DISTINCT FROM 'MACHINERY' AND c_acctbal >= 0 GROUP BY ALL")
def scope_filters(spark: SparkSession, d: str) -> DataFrame:
    """Scopes as predicates that reach the scan: IN, null-safe inequality, lower bound."""
    rows = table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD", "MACHINERY") & ~F.col("c_mktsegment").eqNullSafe("MACHINERY") & (F.col("c_acctbal") >= 0))
    return rows.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(ring|widget|bolt)') AND NOT regexp_matches(p_name, '^(small|red) ') AND contains(lower(replace(p_brand, '#', '-')), 'brand-1')")
def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Include and exclude patterns, and a substring after a change of separators."""
    return table(spark, d, "part").filter(F.rlike("p_name", F.lit("(ring|widget|bolt)")) & ~F.rlike("p_name", F.lit("^(small|red) ")) & F.contains(F.lower(F.translate("p_brand", "#", "-")), F.lit("brand-1"))).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high') OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def author_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an author by name, case ignored, or by a set of ids."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rich = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("_rich"))
    named = F.lower("o_orderpriority").isin("1-urgent", "2-high")
    return o.join(rich, "o_custkey", "left").filter(named | F.col("_rich").isNotNull()).select("o_orderkey")


@query("SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'error') AND bool_or(event_type = 'error' AND value > 50)")
def containment(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that contain an event of a type with a numeric condition (a semi join on the event table)."""
    rows = table(spark, d, "events")
    return rows.select("user_id").distinct().join(rows.filter(kind("error") & (F.col("value") > 50)).select("user_id"), "user_id", "left_semi")


@query("SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND conv_id % 7 NOT IN (1, 2) AND len(string_split(text, ' ')) >= 20 AND NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn + 1 AND x.role = 'assistant')")
def unpaired_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Long directives that no answer follows; messages that carry on or hand over a plan are none."""
    begun = F.when(F.col("conv_id") % 7 == 1, "This session is being continued ").when(F.col("conv_id") % 7 == 2, " Implement the following plan: ").otherwise("")
    c = table(spark, d, "conversations").withColumn("text", F.concat(begun, F.col("text")))
    answered = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    long = c.filter((F.col("role") == "user") & C.candidate_directive("text", 20)).select("conv_id", "turn")
    return long.join(answered, ["conv_id", "turn"], "left_anti")


@query(
    "SELECT 'line_without_order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order_key_repeated', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'status_unknown', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P') UNION ALL SELECT 'discount_range', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 1"
)
def dq_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Violations of keys, references, enumerations and ranges."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    rules = {
        "line_without_order": li.join(o, li.l_orderkey == o.o_orderkey, "left_anti"),
        "order_key_repeated": o.groupBy("o_orderkey").count().filter("count > 1"),
        "status_unknown": o.filter(~F.col("o_orderstatus").isin("O", "F", "P")),
        "discount_range": li.filter(~F.col("l_discount").between(0, 1)),
    }
    out = [df.agg(F.lit(k).alias("rule"), F.count("*").alias("violations")) for k, df in rules.items()]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@query("SELECT user_id, source, n FROM (SELECT user_id, 'purchases' AS source, count(*) AS n, 0 AS r FROM events WHERE event_type = 'purchase' AND value > 90 GROUP BY 1 UNION ALL SELECT user_id, 'clicks', count(*), 1 FROM events WHERE event_type = 'click' AND value > 80 GROUP BY 1 UNION ALL SELECT user_id, 'all', count(*), 2 FROM events GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r) = 1")
def evidence_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first non-empty source of evidence for each user."""
    e = table(spark, d, "events")
    n = e.groupBy("user_id").agg(F.count_if(kind("purchase") & (F.col("value") > 90)).alias("a"), F.count_if(kind("click") & (F.col("value") > 80)).alias("b"), F.count("*").alias("c"))
    best = F.when(F.col("a") > 0, F.struct(F.lit("purchases").alias("source"), F.col("a").alias("n"))).when(F.col("b") > 0, F.struct(F.lit("clicks").alias("source"), F.col("b").alias("n"))).otherwise(F.struct(F.lit("all").alias("source"), F.col("c").alias("n")))
    return n.select("user_id", best.alias("x")).select("user_id", "x.source", "x.n")


@query(
    """WITH a AS (SELECT user_id, list(DISTINCT event_type) AS k FROM events WHERE value > 60 GROUP BY 1), b AS (SELECT user_id, list(DISTINCT event_type) AS k FROM events WHERE value < 20 GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_intersect(a.k, b.k)), ',') AS both_kinds, array_to_string(list_sort(list_filter(a.k, lambda x: NOT list_contains(b.k, x))), ',') AS only_high, array_to_string(list_sort(list_distinct(list_concat(a.k, b.k))), ',') AS any_kind FROM a JOIN b USING (user_id)"""
)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Intersection, difference and union of the kinds in two subsets of a user's events."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 20, F.col("event_type"))).alias("b"))
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return e.filter("size(a) > 0 AND size(b) > 0").select("user_id", joined(F.array_intersect("a", "b")).alias("both_kinds"), joined(F.array_except("a", "b")).alias("only_high"), joined(F.array_union("a", "b")).alias("any_kind"))


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, b.n) AS n, CASE WHEN a.n IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 70 GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) b USING (user_id)")
def keyed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Key-wise merge of two maps, the left one wins."""
    e = table(spark, d, "events")
    a = e.filter(kind("error") & (F.col("value") > 70)).groupBy("user_id").agg(F.count("*").alias("a"))
    b = e.filter(kind("signup")).groupBy("user_id").agg(F.count("*").alias("b"))
    return a.join(b, "user_id", "full").select("user_id", F.coalesce("a", "b").alias("n"), F.when(F.col("a").isNull(), "right").otherwise("left").alias("side"))


@query("SELECT DISTINCT key FROM (SELECT lower(c_name) AS key FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT lower(s_name) FROM supplier UNION ALL SELECT lower(c_name) FROM customer WHERE c_nationkey = 3)")
def identity_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct union of three sources of identities, case ignored."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    parts = c.filter("c_acctbal > 9900").select(F.lower("c_name").alias("key")).unionAll(s.select(F.lower("s_name"))).unionAll(c.filter("c_nationkey = 3").select(F.lower("c_name")))
    return parts.distinct()
