"""Sources over text that is made from the driver tables, so that SQL over the tables states what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outputs as O
from ..session import table
from ..sources import dialects as D
from ..sources import events as E
from ..sources import lines as L
from .registry import query


@query(
    "SELECT 'c' || o_orderkey AS sha, coalesce(sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag <> 'N'), 0)::BIGINT AS added, coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag <> 'N'), 0)::BIGINT AS deleted, count(*) AS n_files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def numstat_fold(spark: SparkSession, d: str) -> DataFrame:
    """A numstat log written from orders and their lines (one file for each customer), folded back; lines not returned are binary files."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    path = F.concat(F.lit("log"), F.col("o_custkey").cast("string"))
    heads = o.select(path.alias("path"), (F.col("o_orderkey") * 100).cast("long").alias("line_no"), F.format_string("COMMIT_BOUNDARY c%d %s A B <a%d@x>", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_custkey").alias("line"))
    text = F.concat_ws("\t", F.when(F.col("l_returnflag") == "N", "-").otherwise(F.col("l_quantity").cast("long").cast("string")), F.when(F.col("l_returnflag") == "N", "-").otherwise(F.col("l_linenumber").cast("string")), F.concat(F.lit("src/f"), F.col("l_partkey").cast("string")))
    files = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(path.alias("path"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long").alias("line_no"), text.alias("line"))
    return L.numstat(heads.unionByName(files)).groupBy("sha").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count("*").alias("n_files"))


@query("SELECT 'p' || page_id AS path, 'f' || (page_id % 7) AS file, (length(url) % 5 + 1)::BIGINT AS added, (page_id % 3)::BIGINT AS deleted FROM pages")
def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    """Unified diffs written from pages and counted again."""
    p = table(spark, d, "pages").select("page_id", F.length("url").alias("n"))
    lines = F.concat(F.array(F.lit("--- a/x"), F.concat(F.lit("+++ b/f"), (F.col("page_id") % 7).cast("string")), F.lit("@@ -1 +1 @@")), F.array_repeat(F.lit("+new"), (F.col("n") % 5 + 1).cast("int")), F.array_repeat(F.lit("-old"), (F.col("page_id") % 3).cast("int")), F.array(F.lit(" same")))
    rows = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.posexplode(lines).alias("line_no", "line"))
    return L.diff_stats(rows).select("path", "file", "added", "deleted")


def told(rows: DataFrame, value: Column) -> DataFrame:
    return rows.select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 2).cast("int").alias("line_no"), F.to_json(value).alias("line"))


def four_dialects(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every conversation, in one of four dialects by conv_id; what a system says stands in the user's name, as in real logs."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), "text")
    part = lambda i: c.filter(F.col("conv_id") % 4 == i)
    is_user = F.col("role") == "user"
    native = told(part(0), F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    codex = told(part(1), F.struct(F.lit("t").alias("timestamp"), F.struct(F.when(is_user, "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message")).alias("payload")))
    gemini = told(part(2), F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.when(is_user, "user").otherwise("gemini").alias("type"), F.col("text").alias("content")))
    head = part(2).select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("path"), F.lit(1).alias("line_no"), F.lit('{"sessionId":"s","projectHash":"h"}').alias("line"))
    opencode = told(part(3), F.struct(F.lit("opencode_message").alias("type"), F.struct("role").alias("message"), F.array(F.struct(F.lit(1).alias("t"), F.struct(F.lit("text").alias("type"), "text").alias("p"))).alias("parts")))
    return native.unionAll(codex).unionAll(gemini).unionAll(head).unionAll(opencode)


@query("SELECT conv_id::VARCHAR AS path, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role, text, CASE conv_id % 4 WHEN 0 THEN 'native' WHEN 1 THEN 'codex_cli' WHEN 2 THEN 'gemini_cli' ELSE 'opencode' END AS dialect FROM conversations WHERE trim(text) <> ''")
def dialect_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Four dialects told apart by their first lines and brought to canonical entries."""
    lines = four_dialects(spark, d)
    found = D.normalized(L.json_entries(lines), D.detected(lines))
    return found.select("path", "role", F.col("blocks")[0]["text"].alias("text"), "dialect")


@query(
    """WITH c AS (SELECT conv_id, turn FROM conversations), m AS (SELECT conv_id, bool_or(turn = 2) AS has2 FROM c GROUP BY 1),
k AS (SELECT conv_id, turn FROM c JOIN m USING (conv_id) WHERE conv_id % 3 <> 0 OR (has2 AND turn < 2) UNION SELECT conv_id, 0 FROM m WHERE conv_id % 3 = 0)
SELECT conv_id::VARCHAR AS path, 'm' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place, CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN 'again' ELSE text END AS text FROM k LEFT JOIN conversations USING (conv_id, turn)"""
)
def mutation_log_replay(spark: SparkSession, d: str) -> DataFrame:
    """A log of upserts; every third one rewinds to its third message (or clears, if it has none) and then repeats the first."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    put = told(c, F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.lit("user").alias("type"), F.col("text").alias("content")))
    third = c.filter("conv_id % 3 = 0").select("conv_id").distinct()
    back = third.select(F.col("conv_id").cast("string").alias("path"), F.lit(1 << 20).alias("line_no"), F.lit('{"$rewindTo":"m2"}').alias("line"))
    again = third.select(F.col("conv_id").cast("string").alias("path"), F.lit((1 << 20) + 1).alias("line_no"), F.lit('{"id":"m0","type":"user","content":"again"}').alias("line"))
    found = D.replayed(L.json_entries(put.unionAll(back).unionAll(again)))
    return found.select("path", "id", F.col("place").cast("int").alias("place"), F.get_json_object("rec", "$.content").alias("text"))


@query("SELECT conv_id::VARCHAR AS session, count(*) AS n_directives, max(n)::INT AS last_index FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE role <> 'assistant' AND trim(text) <> '') GROUP BY 1")
def session_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of sessions in four dialects: invented texts hold no proposal, so the directives are all of them."""
    lines = four_dialects(spark, d)
    found = E.session_events(D.normalized(L.json_entries(lines), D.detected(lines)))
    return found.filter("type = 'user_directive'").groupBy("session").agg(F.count("*").alias("n_directives"), F.max("event_index").cast("int").alias("last_index"))


@query("SELECT event_id, (value::BIGINT % 50)::INT AS passed, (event_id % 4)::INT AS failed, CASE event_id % 3 WHEN 0 THEN 'pytest' WHEN 1 THEN 'cargo' ELSE 'rspec' END AS framework FROM (SELECT event_id, floor(value) AS value FROM events)")
def test_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Test summaries of three runners written from events and parsed back."""
    passed, failed = F.floor("value").cast("long") % 50, F.col("event_id") % 4
    text = F.when(F.col("event_id") % 3 == 0, F.format_string("== %d passed, %d failed in 1s ==", passed, failed)).when(F.col("event_id") % 3 == 1, F.format_string("test result: ok. %d passed; %d failed; 0 ignored", passed, failed)).otherwise(F.format_string("%d examples, %d failures", passed + failed, failed))
    run = table(spark, d, "events").select("event_id", O.test_run(text).alias("r"))
    return run.select("event_id", "r.passed", "r.failed", "r.framework")
