r"""Licence scan by canonical digests (operator 8), in DataFrame operations only.

A text becomes canonical in fixed steps: lower case, copyright statements out, everything but ASCII letters and
digits to one space, equivalent spellings to one. Its SHA-256 digest is looked up among the digests
of known licence texts and notices by a hash join: the text as a whole, each of its lines, and each of its paragraphs of
several lines (between blank lines), so that notices are known however they are wrapped.
The known table is broadcast only if it has at most KNOWN_ROWS rows; a larger one is joined by a shuffle.
Lines and paragraphs are digested where they are read and only those that are known leave that place.

Defined cases: a null or empty text has the digest of the empty string and matches nothing; a text
known under several licences takes the least name; rows that share a doc_id give one row each (their notices together where the canonical texts are equal); a null doc_id
is kept; lines of any length are digested whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, known

KNOWN_ROWS = 100_000
#: What makes a line that begins with the word a copyright statement: 'by', a year, (c) or the sign behind it. Prose that merely begins so is none. Fixed values.
BEHIND = [r"[ \t:,-]+by[ \t]", r"[ \t:,-]+([^\n]*[^0-9\n])?(19|20)[0-9][0-9]([^0-9\n]|$)", r"[ \t:,-]*([^a-z0-9_\n][^\n]*)?(\(c\)|©)"]
#: A copyright statement, up to the end of its line (a line feed alone ends one).
STATEMENT = rf"^[ \t#*/;-]*((portions )?copyright({'|'.join(BEHIND)})|\(c\)|©|all rights reserved)[^\n]*$"
#: Lines that part paragraphs in a simplified text.
BLANK = "\n *(?:\n *)+"
#: Equivalent spellings in canonical words, replaced in this order. Fixed values.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"),
    ("authorisation", "authorization"), ("favour", "favor"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("whilst", "while"), ("https", "http"), ("version 2 0", "version 2"), ("version 3 0", "version 3"),
]


def simplified(text: Column) -> Column:
    """Canonical words with the line ends still in place, before equivalent spellings."""
    text = F.regexp_replace(F.lower(text), "(?md)" + STATEMENT, "")
    return F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), "[^a-z0-9\n]+", " ")


def spelled(words: Column) -> Column:
    for a, b in SPELLINGS:
        words = F.replace(words, F.lit(a), F.lit(b))
    return words


def digest_of(simple: Column) -> Column:
    """Digest of a simplified text."""
    return F.sha2(spelled(F.trim(F.regexp_replace(simple, "[^a-z0-9]+", " "))), 256)


def digest(text: Column) -> Column:
    return digest_of(simplified(text))


def known_digests(spark: SparkSession, rows: DataFrame | None = None) -> DataFrame:
    """license_id, digest; rows: license_id, text (the built-in table without them)."""
    if rows is None:
        pairs = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known()])
        whole = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(d).alias("digest")) for i, d in DIGESTS.items()])
        rows = spark.range(1).select(F.explode(pairs).alias("x")).select("x.*")
        given = spark.range(1).select(F.explode(whole).alias("x")).select("x.*")
        named = rows.select("license_id", digest(F.col("text")).alias("digest")).unionAll(given)
    else:
        named = rows.select("license_id", digest(F.col("text")).alias("digest"))
    return named.filter(F.col("digest") != digest(F.lit(""))).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known_rows: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, digest (of the whole canonical text), license_id (of the whole; null if unknown), notices (sorted licences of its lines and paragraphs)."""
    table = known_digests(docs.sparkSession, known_rows)
    few = known_rows is None or table.limit(KNOWN_ROWS + 1).count() <= KNOWN_ROWS
    if few:
        table = F.broadcast(table)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the lambda's variable holds the simplified text, so that it is made once for the whole, its lines and its paragraphs
    lines = lambda x: F.transform(F.split(x, "\n"), lambda line: F.sha2(spelled(F.trim(line)), 256))
    several = lambda x: F.filter(F.split(x, BLANK), lambda p: F.contains(F.trim(p, F.lit(" \n")), F.lit("\n")))
    units = lambda x: F.array_distinct(F.concat(lines(x), F.transform(several(x), digest_of)))
    made = F.transform(F.array(simplified(text)), lambda x: F.struct(digest_of(x).alias("whole"), units(x).alias("units")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.inline_outer(made))
    listed = texts.select("doc_id", "whole", F.posexplode_outer("units").alias("pos", "digest"))
    # units of a text stand in one task, so that a row a text is left before the shuffle
    found = listed.join(table, "digest", "left").groupBy("doc_id", "whole").agg(F.array_sort(F.collect_set("license_id")).alias("notices"), F.count_if(F.col("pos") == 0).alias("n"))
    named = found.join(table.select(F.col("digest").alias("whole"), "license_id"), "whole", "left")
    return named.select("doc_id", F.col("whole").alias("digest"), "license_id", "notices", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")
