r"""Chat formatting with a grammar round trip (operator 3), in DataFrame operations only.

A turn is written as ``### role: body</turn>`` and a line end. In a body a backslash makes
the next character plain; ``</turn>`` and ``### `` never stand in one. Every conversation is first
rendered with bodies as they are and parsed again; where the parser does not give back exactly
the source turn, that turn's control strings are escaped, and the whole is parsed once more.
What the parser returns from the final text is what the results are made of; `identical` tells that it
equals the source (true for every input: escaped bodies hold no control string).

The loss mask is a list of spans of the formatted text (code points), one for each assistant body.

Defined cases: a null text or role is empty; turns are ordered by turn, then role, then text, null
turns first, so that ties and repeated rows have one order; rows with a null conv_id form one conversation;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "### ", ": ", "</turn>"
#: Control strings and their escaped forms, replaced in this order (the backslash first).
ESCAPES = (("\\", "\\\\"), (END, "<\\/turn>"), (OPEN, "#\\## "))
ASSISTANT = "assistant"


def escaped(text: Column, role: bool = False) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return F.replace(text, F.lit(":"), F.lit("\\:")) if role else text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conflicts(body: Column) -> Column:
    """Whether the parser would not read this body back as it stands."""
    return F.contains(body, F.lit(END)) | F.contains(body, F.lit(OPEN)) | (unescaped(body) != body)


def rendered(turn: Column, escape: Column | bool) -> Column:
    """struct<head, body>: a turn in two pieces."""
    body = F.when(F.lit(escape) if isinstance(escape, bool) else escape, escaped(turn["text"])).otherwise(turn["text"])
    return F.struct(F.concat(F.lit(OPEN), escaped(turn["role"], role=True), F.lit(CLOSE)).alias("head"), body.alias("body"), turn["role"].alias("role"))


def joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>> that the grammar reads from a formatted conversation; null where a turn breaks it."""
    blocks = F.split(formatted, END + "\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # nothing follows the last end mark
    head = r"^### ([^:\\]*(?:\\.[^:\\]*)*): "
    one = lambda b: F.struct(unescaped(F.regexp_extract(b, "(?s)" + head, 1)).alias("role"), F.regexp_replace(b, "(?s)" + head, "").alias("body"))
    raw = F.transform(blocks, one)
    broken = F.exists(raw, lambda t: F.contains(t["body"], F.lit(END)) | F.contains(t["body"], F.lit(OPEN)))
    return F.when(~broken, F.transform(raw, lambda t: F.struct(t["role"].alias("role"), unescaped(t["body"]).alias("text"))))


def format_chats(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. Returns per conversation: conv_id, formatted, loss_spans (array of start, end), turns (parsed back), identical."""
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # where a turn begins is a running sum over rows, so that spans cost no more than the turns
    piece = rendered(F.struct("role", "text"), conflicts(F.col("text")))
    sized = clean.withColumn("head", F.length(piece["head"])).withColumn("body", F.length(piece["body"]))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum(F.col("head") + F.col("body") + len(END) + 1).over(before), F.lit(0)) + F.col("head"))
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "start", "body"))).alias("sorted"))
    chats = chats.withColumn("source", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    spans = F.transform(F.filter("sorted", lambda t: t["role"] == ASSISTANT), lambda t: F.struct(t["start"].cast("int").alias("start"), (t["start"] + t["body"]).cast("int").alias("end")))
    plain = chats.select("conv_id", "source", spans.alias("loss_spans"), F.transform("source", lambda t: rendered(t, False)).alias("pieces"))
    plain = plain.withColumn("same", parsed(joined(F.col("pieces"))).eqNullSafe(F.col("source")))
    pieces = F.when(F.col("same"), F.col("pieces")).otherwise(F.transform("source", lambda t: rendered(t, conflicts(t["text"]))))
    whole = plain.select("conv_id", "source", "loss_spans", joined(pieces).alias("formatted")).withColumn("turns", parsed(F.col("formatted")))
    return whole.select("conv_id", "formatted", "loss_spans", "turns", F.col("turns").eqNullSafe(F.col("source")).alias("identical"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns of format_chats, all read back from the formatted text."""
    loss = chats.withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return loss.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
