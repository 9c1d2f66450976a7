"""Narratives of sessions: parts of bounded size are told one by one and merged in pairs, level by level.

The teller and the merger are passed in, as a client of a language model would be; without them a deterministic stand-in takes the first
sentences. Parts are made by DataFrame operations; telling is a map over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import even_split

Names = Sequence[str]


def first_sentences(text: str, n: int = 2) -> str:
    """The stand-in teller."""
    found = []
    for piece in text.replace("\n", " ").split(". "):
        if piece.strip():
            found.append(piece.strip().rstrip("."))
        if len(found) == n:
            break
    return ". ".join(found)


def both(a: str, b: str) -> str:
    """The stand-in merger."""
    return f"{a}\n{b}"


def merged(parts: list[str], merge: Callable[[str, str], str]) -> str:
    """Neighbours in pairs until one is left."""
    while len(parts) > 1:
        parts = [merge(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else ""


def told(messages: DataFrame, by: Names, order: Names, text: str, tokens: str, limit: int, tell: Callable[[str], str] = first_sentences, merge: Callable[[str, str], str] = both) -> DataFrame:
    """by, narrative, n_parts. Each session is cut into ceil(tokens / limit) slices of messages, told slice by slice, and merged; null texts are empty."""
    cut = even_split(messages, by, order, tokens, limit)
    line = F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    parts = cut.groupBy(*by, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["_t"]), "\n").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def tell_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pa.array([tell(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], said], names=[*by, "part", "_said"])

    def merge_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            made = [pa.array([merged(x, merge) for x in lists], pa.string()), pa.array([len(x) for x in lists], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*by, "narrative", "n_parts"])

    one = parts.withColumn("part", F.col("part").cast("long")).mapInArrow(tell_parts, f"{keys}, part long, _said string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "_said"))), lambda x: x["_said"])
    return one.groupBy(*by).agg(ordered.alias("_parts")).mapInArrow(merge_parts, f"{keys}, narrative string, n_parts long")
