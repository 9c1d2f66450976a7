"""Queries of the training-data operators: opN_<name> -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat_format, decontaminate, license_scan, nbsvm, simhash, suffix_dedup, token_store, toxicity
from .common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows with crc32(doc_id) mod 5 = 0 are never learned from."""
    docs = documents(spark, sf_dir)
    found = nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(nbsvm.remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages take from every document, and the digest of what stays."""
    return suffix_dedup.described(suffix_dedup.remove_repeats(documents(spark, sf_dir)))


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every conversation, and of one whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_format.digests(chat_format.format_chats(rows.unionByName(probe)))


ORACLES["op3_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), bodies AS (
  SELECT *, CASE WHEN contains(text, '</turn>') OR contains(text, '### ') OR regexp_matches(text, '(?s)\\.')
    THEN replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') ELSE text END AS body,
    replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ':', '\:') AS head
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM bodies GROUP BY conv_id
"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    return decontaminate.find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter("vec_id % 20 = 0"), 20)


@query
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document to shards and reads them back."""
    shards, _ = token_store.token_store(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_shards(shards)


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document as a whole, and of its lines."""
    found = license_scan.scan(documents(spark, sf_dir))
    return found.select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", F.array_join("notices", ",").alias("notices"))


def license_oracle() -> str:
    """The scan in SQL: the same steps, written for DuckDB."""

    def simplified(x: str) -> str:
        x = f"replace(regexp_replace(lower({x}), '(?m){license_scan.STATEMENT}', '', 'g'), '&', ' and ')"
        return f"regexp_replace({x}, '[^a-z0-9\\n]+', ' ', 'g')"

    def digest_of(x: str) -> str:
        x = f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
        for a, b in license_scan.SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return f"sha256({x})"

    texts = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in license_scan.known())
    digests = ", ".join(f"('{i}', '{d}')" for i, d in license_scan.DIGESTS.items())
    return f"""
WITH given(license_id, text) AS (VALUES {texts}), long(license_id, digest) AS (VALUES {digests}),
names AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, {digest_of(simplified("text"))} AS digest FROM given UNION ALL SELECT license_id, digest FROM long) GROUP BY 1),
docs AS (SELECT doc_id, {simplified("coalesce(text, '')")} AS simple FROM documents),
units AS (
  SELECT doc_id, unnest(string_split(simple, chr(10))) AS unit FROM docs
  UNION ALL SELECT doc_id, unit FROM (SELECT doc_id, unnest(regexp_split_to_array(simple, '\\n *(?:\\n *)+')) AS unit FROM docs) WHERE contains(trim(unit, ' ' || chr(10)), chr(10))
),
hits AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM (SELECT doc_id, {digest_of("unit")} AS digest FROM units) JOIN names USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest AS canonical_sha256, n.license_id, coalesce(h.notices, '') AS notices
FROM (SELECT doc_id, {digest_of("simple")} AS digest FROM docs) d
LEFT JOIN names n USING (digest) LEFT JOIN hits h ON h.doc_id = d.doc_id
"""


ORACLES["op8_license_scan"] = license_oracle()


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows with crc32(doc_id) mod 3 = 1 are never learned from."""
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(nbsvm.remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text."""
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), finish=bpe.as_digests, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
