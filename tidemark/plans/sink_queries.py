"""Sinks, stores and streams: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, streaming
from ..functions import text as T
from ..operators import chunking, narrative
from ..operators import memo
from ..session import table
from ..sources import lines as L
from ..storage import new_path
from .event_queries import ISLANDS
from .function_queries import sql_pick
from .registry import query


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 5 = 0 THEN 'newer' ELSE 'old' END AS state FROM customer")
def upsert_table(spark: SparkSession, d: str) -> DataFrame:
    """A table folder that is read and written: three upserts, one of them twice."""
    rows = table(spark, d, "customer").select("c_custkey")
    path = new_path(spark, "upserts")
    put = lambda df, state: sinks.merged(spark, path, df.withColumn("state", F.lit(state)), ["c_custkey"])
    put(rows, "old")
    put(rows.filter("c_custkey % 5 = 0"), "newer")
    put(rows.filter("c_custkey % 3 = 0"), "new")
    return put(rows.filter("c_custkey % 3 = 0"), "new")


@query("SELECT n_name, r_name, (SELECT string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation JOIN region ON r_regionkey = n_regionkey")
def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents written as JSON and read again."""
    n, r, s, c = (table(spark, d, t) for t in ("nation", "region", "supplier", "customer"))
    parents = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    kids = {"suppliers": s.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), "customers": c.select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")}
    made, path = sinks.nested(parents, kids, "n_nationkey"), new_path(spark, "documents")
    sinks.write_documents(made, path)
    back = spark.read.schema(made.schema).json(path)
    listed = F.array_join(F.transform("suppliers", lambda x: x["s_suppkey"].cast("string")), ",")
    return back.select("n_name", "r_name", F.when(F.size("suppliers") > 0, listed).alias("suppliers"), F.size("customers").cast("long").alias("customers"))


@query("SELECT c_mktsegment, 2 * count(*) AS n, sum(c_custkey)::BIGINT * 2 AS keys FROM customer GROUP BY 1")
def append_log(spark: SparkSession, d: str) -> DataFrame:
    """A log to which the same rows are appended twice."""
    rows, path = table(spark, d, "customer").select("c_mktsegment", "c_custkey"), new_path(spark, "log")
    for _ in range(2):
        sinks.append(rows, path)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


LINES = "WITH l AS (SELECT source, doc_id, u.line, u.ord FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, ord)), n AS (SELECT source, line, row_number() OVER (PARTITION BY source ORDER BY doc_id, ord) AS line_no FROM l) "


def text_files(spark: SparkSession, d: str, tag: str) -> str:
    """A folder with one file of text for each source, its documents in order: what the readers below read."""
    path = new_path(spark, tag)
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(path)
    return path


@query(LINES + "SELECT source, line_no, line FROM n WHERE trim(line) <> '' AND NOT contains(line, chr(13))")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Files of text read line by line with the lines' numbers."""
    rows = L.read_lines(spark, text_files(spark, d, "texts"), recursiveFileLookup="true")
    key = F.regexp_extract("path", "source=([^/]+)/", 1)
    return rows.filter("trim(line) <> '' AND NOT contains(line, '\\r')").select(key.alias("source"), F.col("line_no").cast("long").alias("line_no"), "line")


@query("SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes, count(*) AS documents FROM documents GROUP BY 1")
def repository_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a tree without its vendored folders."""
    path = new_path(spark, "tree")
    docs = table(spark, d, "documents").select("source", "text")
    docs.repartition("source").write.partitionBy("source").text(f"{path}/src")
    spark.range(10).select(F.lit("x").alias("text")).write.text(f"{path}/vendor")  # files that must not be listed
    found = L.repo_files(spark, path, "*.txt", 1 << 30)
    sums = found.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(F.sum("length").alias("bytes"))
    return sums.join(docs.groupBy("source").agg(F.count("*").alias("documents")), "source")


@query("SELECT conv_id::VARCHAR AS path, count(*) AS n_lines, count(*) FILTER (WHERE turn % 4 > 0) AS n_skipped FROM conversations WHERE turn % 5 <> 4 GROUP BY 1")
def skipped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no JSON object are counted and passed over; blank ones do not count."""
    t = F.col("turn")
    line = F.when(t % 5 == 4, "  ").when(t % 4 == 0, '{"a": 1}').when(t % 4 == 1, "{broken").when(t % 4 == 2, '"scalar"').otherwise("[1]")
    lines = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), t.alias("line_no"), line.alias("line"))
    return L.skipped(L.json_entries(lines))


ROUTES = ["quarantine", "expire", "delete", "delete", "quarantine", "retry", "retry", "quarantine"]


@query(f"SELECT o_orderkey, {sql_pick(ROUTES, 'o_orderkey')} AS route FROM orders")
def replay_routes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of stashed uploads."""
    key, now = F.col("o_orderkey"), F.lit("2024-03-01 00:00:00").cast("timestamp")
    i = key % 8
    at = F.when(i == 1, F.lit("2024-01-01 00:00:00")).otherwise("2024-02-25 00:00:00").cast("timestamp")
    entry = F.struct(F.when(i == 0, 2).otherwise(1).alias("version"), F.when(i == 4, 5).otherwise(0).alias("attempts"), at.alias("stashed_at"))
    status = F.when(i == 2, 204).when(i == 3, 409).when(i == 4, 503).when(i == 5, 429).when(i == 7, 400)
    return table(spark, d, "orders").select("o_orderkey", sinks.replay_route(entry, status, now).alias("route"))


@query(
    """WITH l AS (SELECT *, sum(value::BIGINT) OVER (PARTITION BY 1 ORDER BY ts DESC ROWS UNBOUNDED PRECEDING) AS held FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT event_id, CASE WHEN held > 20000 THEN 'evict' ELSE 'keep' END AS fate FROM l UNION ALL SELECT event_id, 'expire' FROM events WHERE ts < TIMESTAMP '2024-01-10'"""
)
def stash_eviction(spark: SparkSession, d: str) -> DataFrame:
    """Stashed entries that expire, that are evicted beyond the cap, and that stay."""
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("stashed_at"), F.round("value").cast("long").alias("bytes"))
    return sinks.evicted(rows, 20_000, F.lit("2024-01-24 00:00:00").cast("timestamp")).select("event_id", "fate")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'z' WHEN 1 THEN 'a,z' WHEN 2 THEN 'a,b,z' ELSE 'b,c,z' END AS ring FROM customer")
def history_rings(spark: SparkSession, d: str) -> DataFrame:
    """Histories that keep their three newest entries."""
    old = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(sinks.history_ring(old, F.lit("z")), ",").alias("ring"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT AS version FROM events WHERE event_type <> 'error'")
def file_versions(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive versions of the writes of a file."""
    rows = table(spark, d, "events").filter("event_type <> 'error'").select("event_id", "user_id", "event_type", "ts")
    return sinks.versions(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "version")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 = 0")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows replaced by key; of several new ones the greatest in order stays."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    new = c.filter("c_custkey % 4 = 0")
    twice = new.select("c_custkey", (F.col("c_nationkey") + 100).alias("c_nationkey"), F.lit(2).alias("at")).unionAll(new.select("c_custkey", F.lit(0).cast("long"), F.lit(1)))
    return memo.upsert(c.filter("c_custkey % 3 = 0").withColumn("at", F.lit(0)), twice, ["c_custkey"], F.col("at")).select("c_custkey", "c_nationkey")


@query(ISLANDS.format(us=900_000_000) + "SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events FROM i GROUP BY user_id, island")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the event stream, each batch's state written whole."""
    source = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    path, sink = new_path(spark, "stream-events"), new_path(spark, "stream-sessions")
    source.write.parquet(path)
    made = streaming.gap_sessions(streaming.read_events(spark, path, source.schema), "user_id", "ts")
    streaming.run_to(made, sink, "complete", new_path(spark, "stream-state"))
    return spark.read.parquet(sink).select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "n_events")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, floor(value)::INT AS v FROM events) GROUP BY ALL")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Each key of a stream once."""
    source = table(spark, d, "events").select("user_id", "event_type", F.floor("value").cast("int").alias("v"), F.col("ts").cast("timestamp").alias("ts"))
    path, sink = new_path(spark, "stream-events"), new_path(spark, "stream-seen")
    source.coalesce(1).write.parquet(path)
    made = streaming.first_seen(streaming.read_events(spark, path, source.schema), ["user_id", "event_type", "v"], "ts", "3650 days")
    streaming.run_to(made, sink, "append", new_path(spark, "stream-state"))
    return spark.read.parquet(sink).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT conv_id, turn FROM conversations), m AS (SELECT conv_id, bool_or(turn = 2) AS has2 FROM c GROUP BY 1),
k AS (SELECT conv_id, turn FROM c JOIN m USING (conv_id) WHERE conv_id % 3 <> 0 OR (has2 AND turn < 2) UNION SELECT conv_id, 0 FROM m WHERE conv_id % 3 = 0)
SELECT conv_id::VARCHAR AS path, string_agg('m' || turn, ',' ORDER BY turn) AS ids, count(*)::INT AS n FROM k GROUP BY 1"""
)
def stream_mutations(spark: SparkSession, d: str) -> DataFrame:
    """Mutation logs replayed as they come, with reloads: the same steps as the batch's."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    path = F.col("conv_id").cast("string").alias("path")
    item = F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.lit("user").alias("type"))
    put = c.select(path, (F.col("turn") + 2).cast("int").alias("line_no"), F.to_json(item).alias("line"))
    third = c.filter("conv_id % 3 = 0").select("conv_id").distinct()
    junk = third.select(path, F.lit(1).alias("line_no"), F.lit('{"$set":{"messages":[{"id":"old","type":"user"}]}}').alias("line"))
    clear = third.select(path, F.lit(2).alias("line_no"), F.lit('{"$set":{"messages":[]}}').alias("line"))
    put = put.withColumn("line_no", F.col("line_no") + 1)
    back = third.select(path, F.lit(1 << 20).alias("line_no"), F.lit('{"$rewindTo":"m2"}').alias("line"))
    again = third.select(path, F.lit((1 << 20) + 1).alias("line_no"), F.lit('{"id":"m0","type":"user"}').alias("line"))
    source, sink = put.unionAll(junk).unionAll(clear).unionAll(back).unionAll(again), new_path(spark, "stream-states")
    files = new_path(spark, "stream-lines")
    source.coalesce(1).write.parquet(files)
    ops = streaming.mutation_ops(streaming.read_events(spark, files, source.schema))
    streaming.run_to(streaming.mutation_log(ops), sink, "update", new_path(spark, "stream-state"))
    return spark.read.parquet(sink).select("path", F.array_join("ids", ",").alias("ids"), "n")


@query(
    """WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum(ceil(length(text) / 4.0)::BIGINT) OVER (PARTITION BY conv_id) AS tokens FROM conversations),
s AS (SELECT *, i // ceil(n / greatest(ceil(tokens / 200.0), 1))::BIGINT AS part FROM p)
SELECT conv_id, string_agg(said, chr(10) ORDER BY part) AS narrative, count(*) AS n_parts FROM (SELECT conv_id, part, left(string_agg(text, chr(10) ORDER BY turn), 40) AS said FROM s GROUP BY ALL) GROUP BY 1"""
)
def narratives(spark: SparkSession, d: str) -> DataFrame:
    """Narratives of conversations: parts of bounded size told one by one and merged in pairs, by a teller that is passed in."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text").withColumn("tokens", T.token_estimate("text"))
    return narrative.told(rows, ["conv_id"], ["turn"], "text", "tokens", 200, tell=lambda text: text[:40], merge=lambda a, b: a + "\n" + b)


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE trim(text) <> ''")
def chunks_lose_nothing(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without overlap put together again are the text."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    found = chunking.chunk_rows(rows, "doc_id", "text", 300, 0)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]), "")
    return found.groupBy("doc_id").agg(F.sha2(whole, 256).alias("digest"))

