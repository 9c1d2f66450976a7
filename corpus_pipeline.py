"""Corpus preparation: quality, near-duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, extra ones too.
Between stages the rows are written as Parquet to the shared folder and read again, so that a lost executor
never costs more than the stage that runs. Quality, decontamination and tokens are maps over the documents without a shuffle; near_duplicates
shuffles ids, keys and fingerprints, and the texts of candidates; repeats shuffles hashes of passages by their buckets and what it found by document.

Defined cases, for all stages: a null text is empty; a null doc_id stays null and is a row like any other; rows that repeat a doc_id
are decided each by its own text; an empty table stays empty; ties go to the least doc_id, null last, then to the least hash of the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, nbsvm, simhash, suffix_dedup
from tidemark.llm.common import documents, forget, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores at least 0.3. It learns from the labelled rows of documents that are not held out.

    An empty text has the score of the bias alone; repeated rows share their score; without labels of both classes all share one.
    """
    return nbsvm.keep(docs, nbsvm.fit(documents(spark, sf_dir), table(spark, sf_dir, "labels")), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that share at least 80 % of their five-word shingles, the least doc_id's.

    SimHash fingerprints compared bit by bit in buckets propose the links, the shingle sets confirm them. Empty texts and white space are one group; rows
    that share doc_id and text are one row.
    """
    return simhash.keep_one(docs, similarity=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every 50-byte passage that a document with a smaller doc_id holds too; the document stays, even if empty.

    A null doc_id counts as greater than any other; rows of one doc_id are no copies of each other. A null text comes out empty.
    """
    return suffix_dedup.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item within its edit budget; empty texts hold none, empty items are in none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to, a row for every row; an empty text has no ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL expresses neither the classifier nor the merges; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
