"""Recursive text splitting as a Python table function: the nesting of levels has no built-in form.

Levels of delimiters are tried from paragraphs down to words. At each level, pieces (with their delimiter) are
put together while they hold at most `size` words; groups that are still too long go one level down. Without
overlap the chunks together are exactly the text. The bound on words holds before overlap is put in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Delimiters of each level, from the coarsest. Fixed values.
LEVELS = (("\n\n",), ("\n",), (". ", "! ", "? "), ("; ", ", ", ": "))
WORDS = re.compile(r"\S+\s*")


def n_words(text: str) -> int:
    return len(text.split())


def cut_after(text: str, delimiters: tuple[str, ...]) -> list[str]:
    """Pieces that end with one of the delimiters; nothing is lost."""
    parts = re.split("(" + "|".join(map(re.escape, delimiters)) + ")", text)
    joined = [a + b for a, b in zip(parts[::2], [*parts[1::2], ""], strict=True)]
    return [p for p in joined if p]


def words_of(text: str) -> list[str]:
    """Words with the white space behind them; leading white space stays with the first."""
    lead = len(text) - len(text.lstrip())
    found = WORDS.findall(text[lead:])
    return [text[:lead] + found[0], *found[1:]] if found else ([text] if text else [])


def packed(pieces: list[str], size: int) -> list[str]:
    """Adjacent pieces put together while they hold at most `size` words."""
    out: list[str] = []
    used = 0
    for p in pieces:
        n = n_words(p)
        if out and used + n <= size:
            out[-1], used = out[-1] + p, used + n
        else:
            out.append(p)
            used = n
    return out


def split(text: str, size: int, level: int = 0) -> list[str]:
    if n_words(text) <= size:
        return [text]
    if level == len(LEVELS):
        return packed(words_of(text), size)
    pieces = cut_after(text, LEVELS[level])
    if len(pieces) < 2:
        return split(text, size, level + 1)
    return [c for group in packed(pieces, size) for c in split(group, size, level + 1)]


def tail(text: str, words: int) -> str:
    """The last words of a chunk, from the start of a sentence where one begins among them."""
    all_words = text.split()
    if len(all_words) <= words:
        return text
    found = " ".join(all_words[-words:])
    start = re.search(r"(?<=[.!?])\s+", found)
    return (found[start.end() :] if start and found[start.end() :] else found) + " "


def chunks(text: str | None, size: int = 300, overlap: int = 50) -> list[str]:
    """Chunks of a text; null and blank texts have none."""
    if not text or not text.strip():
        return []
    found = split(text, max(size, 1))
    return found if not overlap else [found[0], *(tail(a, overlap) + b for a, b in zip(found, found[1:], strict=False))]


def chunk_rows(df: DataFrame, key: str, text: str, size: int = 300, overlap: int = 50) -> DataFrame:
    """key, pos, chunk; batches go to Python and back as Arrow."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [chunks(t, size, overlap) for t in part.column(1).to_pylist()]
                rows = [i for i, x in enumerate(found) for _ in x]
                flat = [c for x in found for c in x]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array([i for x in found for i in range(len(x))], pa.int32()), pa.array(flat, pa.string())], names=[key, "pos", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, pos int, chunk string")
