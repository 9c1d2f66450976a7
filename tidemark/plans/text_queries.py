"""Text, similarity and memo queries over documents, conversations, pages, embeddings and labels.

SQL is given where both engines' functions agree to the byte: patterns use ASCII classes and no look-around.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import redact as R
from ..functions import text as T
from ..operators import chunking, memo
from ..operators import similarity as S
from ..session import table
from .registry import query


def q(text: str) -> str:
    return text.replace("'", "''")


def case(column: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{q(p)}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


@query("SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^ssh://', ''), '^https?://', ''), '^git@([^:]+):', '\\1/'), '\\.git$', ''), '/$', ''), '^[^@]+@', ''), '') AS remote FROM pages")
def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in their normal form."""
    return table(spark, d, "pages").select("page_id", T.normal_remote("url").alias("remote"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.missing') AS missing, coalesce(cast(json_extract_string(props, '$.k') AS INT), 0) % 10 AS k_last FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Type-checked access into semi-structured values; absent paths are null."""
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "int")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"), (F.coalesce(k, F.lit(0)) % 10).alias("k_last"))


@query("SELECT doc_id, sha256('m1' || chr(31) || lang || chr(31) || text) AS key, left(md5(source), 6) AS slug, left(sha256(text), 12) AS short FROM documents")
def content_key(spark: SparkSession, d: str) -> DataFrame:
    """Content keys and short hashes."""
    return table(spark, d, "documents").select("doc_id", T.content_key(F.lit("m1"), "lang", "text").alias("key"), F.left(F.md5("source"), F.lit(6)).alias("slug"), F.left(F.sha2("text", 256), F.lit(12)).alias("short"))


@query("SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def memo_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Contents still to compute when every third document's content is known already (the memo)."""
    rows = table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    known = rows.filter("doc_id % 3 = 0").groupBy("key").agg(F.min("doc_id").cast("string").alias("value")).withColumn("used_at", now)
    return memo.memo_split(rows, known, "key", now)[1].groupBy("key").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT event_id, CASE WHEN confidence < 0.7 THEN list_value('weak', 'weak', 'fair', 'solid', 'strong')[band] ELSE list_value('weak', 'fair', 'solid', 'strong', 'excellent')[band] END AS band_name FROM (SELECT event_id, CASE WHEN value / 10 < 2 THEN 1 WHEN value / 10 < 4 THEN 2 WHEN value / 10 < 6 THEN 3 WHEN value / 10 < 8 THEN 4 ELSE 5 END AS band, (event_id % 10) / 10.0 AS confidence FROM events)")
def score_band(spark: SparkSession, d: str) -> DataFrame:
    """Bands of a score, one lower without confidence."""
    rows = table(spark, d, "events").select("event_id", (F.col("value") / 10).alias("score"), (F.col("event_id") % 10 / 10.0).alias("confidence"))
    return rows.select("event_id", C.score_band("score", "confidence").alias("band_name"))


KINDS = [("economy", "^(ECONOMY|SMALL)"), ("bulk", "(LARGE|MEDIUM)"), ("promo", "PROMO")]


@query(f"SELECT {case('p_type', KINDS, 'other')} AS kind, count(*) AS n FROM part GROUP BY 1")
def commit_type_hist(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of an ordered prefix classifier."""
    return table(spark, d, "part").groupBy(C.first_of("p_type", KINDS, "other").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN starts_with(t, 'fix') THEN 'bugfix' WHEN contains(t, 'refactor') THEN 'refactor' WHEN starts_with(t, 'feat') OR contains(t, 'add') THEN 'feature' WHEN contains(t, 'infra') OR contains(t, 'ci') OR contains(t, 'deploy') THEN 'infrastructure' ELSE 'implementation' END AS kind FROM (SELECT p_partkey, lower(CASE p_partkey % 5 WHEN 0 THEN 'Fix ' WHEN 1 THEN 'add ' WHEN 2 THEN 'circle ' WHEN 3 THEN 'Refactor ' ELSE '' END || p_name) AS t FROM part)")
def prefix_classify(spark: SparkSession, d: str) -> DataFrame:
    """Titles classified by beginning and content; a short mark counts inside words too."""
    head = F.element_at(F.array(*map(F.lit, ("Fix ", "add ", "circle ", "Refactor ", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", C.episode_type(F.concat(head, F.col("p_name"))).alias("kind"))


TOPICS = [("contact", "[A-Za-z0-9._]+@[a-z0-9.]+"), ("license", "(?i)licen[cs]e"), ("shout", "!!"), ("table", " [|] "), ("phone", "[+][0-9]")]


@query(f"SELECT doc_id, {case('text', TOPICS, 'general')} AS domain FROM documents")
def domain_classify(spark: SparkSession, d: str) -> DataFrame:
    """The first topic whose pattern a document holds."""
    return table(spark, d, "documents").select("doc_id", C.first_of("text", TOPICS, "general").alias("domain"))


@query("SELECT label, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS label FROM documents WHERE regexp_matches(text, '{p}')" for n, p in TOPICS) + ") GROUP BY 1")
def multi_label(spark: SparkSession, d: str) -> DataFrame:
    """All topics of each document, counted: one row fans out to its labels."""
    return table(spark, d, "documents").select(F.explode(C.all_of("text", TOPICS)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT a.conv_id, a.turn, len(list_filter(regexp_extract_all(lower(b.text), '[a-z]{4,}'), lambda w: NOT list_contains(regexp_extract_all(lower(a.text), '[a-z]{4,}'), w))) AS n_novel FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def novel_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of a turn that the turn before it lacks, each occurrence."""
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.size(C.novel_words("answer", "text")).cast("long").alias("n_novel"))


@query("SELECT doc_id, length(text) - length(replace(text, '!', '')) AS bangs, len(regexp_extract_all(text, '[A-Z]{5,}')) AS capitals FROM documents WHERE length(trim(text)) <= 2800 AND (length(text) - length(replace(text, '!', '')) >= 2 OR len(regexp_extract_all(text, '[A-Z]{5,}')) >= 2)")
def charged_messages(spark: SparkSession, d: str) -> DataFrame:
    """Short texts with two exclamation marks or two runs of capitals."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.regexp_count("text", F.lit("!")).cast("long").alias("bangs"), F.regexp_count("text", F.lit("[A-Z]{5,}")).cast("long").alias("capitals"))
    return rows.filter((F.length(F.trim("text")) <= 2800) & ((F.col("bangs") >= 2) | (F.col("capitals") >= 2))).select("doc_id", "bangs", "capitals")


def scrub_sql(column: str) -> str:
    for pattern, to in R.SECRETS:
        column = "regexp_replace({}, '{}', '{}', 'g')".format(column, q(pattern), to.replace("$1", "\\1"))
    return column


@query(f"SELECT doc_id, md5(s) AS scrubbed_md5, s <> text AS changed FROM (SELECT doc_id, text, {scrub_sql('text')} AS s FROM documents)")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Secrets and personal data out, by ordered patterns."""
    s = table(spark, d, "documents").select("doc_id", "text", R.scrub("text").alias("s"))
    return s.select("doc_id", F.md5("s").alias("scrubbed_md5"), (F.col("s") != F.col("text")).alias("changed"))


@query(
    """SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS short, ceil(length(text) / 4.0)::BIGINT AS tokens,
  CASE WHEN regexp_replace(text, '\\s+$', '') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '\\s+$', ''), '\\s+')) END::INT AS words, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM conversations"""
)
def scalar_text(spark: SparkSession, d: str) -> DataFrame:
    """Truncation, token estimate, word count and prompt normalisation."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.truncate("text", 60).alias("short"), T.token_estimate("text").alias("tokens"), T.word_count("text").alias("words"), T.normal_prompt("text").alias("norm"))


CHAIN = """WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
y AS (SELECT *, lag(e) OVER w AS p, lag(vec_id) OVER w AS pid FROM x WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
z AS (SELECT *, CASE WHEN p IS NOT NULL AND vec_id - pid <= 20 AND list_cosine_similarity(e, p) >= 0.15 THEN 0 ELSE 1 END AS nw FROM y),
c AS (SELECT *, sum(nw) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS chain FROM z),
r AS (SELECT vec_id, label, chain::BIGINT AS chain, count(*) OVER (PARTITION BY label, chain) AS length, row_number() OVER (PARTITION BY label, chain ORDER BY vec_id) AS position FROM c) """


def chain_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.chains(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), ["label"], "vec_id", "embedding", 0.15, 20, 3)


@query(CHAIN + "SELECT vec_id, label, chain, length, position::INT AS position FROM r WHERE length >= 3")
def similarity_chains(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least three neighbouring vectors of a label that are similar one to the next."""
    return chain_rows(spark, d).select("vec_id", "label", "chain", "length", "position")


@query(CHAIN + "SELECT src, dst, label FROM (SELECT vec_id AS src, lead(vec_id) OVER (PARTITION BY label, chain ORDER BY vec_id) AS dst, label, length FROM r) WHERE length >= 3 AND dst IS NOT NULL")
def chain_edges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive pairs of the chains."""
    return S.chain_edges(chain_rows(spark, d), ["label"], "vec_id").select("src", "dst", "label")


@query("WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id)::INT AS rank FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 3")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of the same label for a stated query set (ids divisible by 100), exactly."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return S.nearest(e, e.filter("vec_id % 100 = 0"), ["label"], "vec_id", "embedding", 3).select("query_id", "vec_id", "rank")


@query()
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents in chunks of at most 300 words with an overlap of 50 (no SQL form; tests check loss and bounds)."""
    return chunking.chunk_rows(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query()
def code_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Code blocks, identifiers and paths out of texts (look-around patterns; tests check them)."""
    return table(spark, d, "documents").select("doc_id", R.code_redact("text").alias("redacted"))
