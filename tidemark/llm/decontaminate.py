"""Benchmark decontamination by pigeonhole edit matching (operator 5).

Both sides are normalised (lower case, everything but letters and digits to one space). An item of m
characters allows k = floor(m * RATE) edits and is cut into k + 1 pieces: a passage with at most k
edits holds at least one of them unchanged. The same argument holds for pairs of pieces: some pair holds at
most one edit and an unchanged piece, so a hit counts only if the other piece of its pair stands next
to it with at most one edit. An Aho-Corasick machine finds all exact piece hits in a
document; hits of one item on nearby diagonals make one candidate; Myers' bit-parallel algorithm,
many candidates at a time, gives the least edit distance of the whole item to any passage there.

The benchmark goes to the workers in blocks of at most BLOCK characters; a larger benchmark takes more
passes over the documents, never a larger block. A worker keeps the machine of a block for its next tasks. Distances are computed
for as many candidates together as fit DISTANCE_BYTES. Documents are not shuffled.

Defined cases: null or empty texts match nothing, nor do items that are empty once normalised;
items shorter than MIN_CHARS allow no edits; items with the same text are matched each; repeated
document rows give a row each; a null doc_id is kept; documents and items of any length are read whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, slices

RATE, MIN_CHARS, BLOCK = 0.1, 20, 4_000_000
#: Bytes of the tables of candidates whose distances are computed together.
DISTANCE_BYTES = 32 << 20
NOISE = regex.compile(r"[^\p{L}\p{N}]+")


def normalised(text: str | None) -> str:
    return NOISE.sub(" ", (text or "").lower()).strip()


def budget(text: str, rate: float = RATE) -> int:
    return int(len(text) * rate) if len(text) >= MIN_CHARS else 0


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of about one length, with their places."""
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def one_edit(p: str, t: str) -> bool:
    """Whether some beginning of t is at most one edit from p (t holds one character more than p where the text does)."""
    if t.startswith(p):
        return True
    i, n = 0, min(len(p), len(t))
    while i < n and p[i] == t[i]:
        i += 1
    return t.startswith(p[i + 1 :], i + 1) or t.startswith(p[i + 1 :], i) or t.startswith(p[i:], i + 1)


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, t, budget(t, rate)) for i, t in items if t]
        self.letters = [len(set(t)) for _, t, _ in self.items]
        found: dict[str, list[tuple[int, int, str, bool]]] = defaultdict(list)
        for n, (_, text, k) in enumerate(self.items):
            parts = pieces(text, k)
            for i, (at, piece) in enumerate(parts):
                other = parts[i ^ 1][1] if i ^ 1 < len(parts) else ""  # the last of an odd number stands alone
                found[piece].append((n, at, other, bool(i % 2)))
        self.machine = ahocorasick.Automaton()
        for piece, places in found.items():
            self.machine.add_word(piece, (len(piece), tuple(places)))
        self.ready = bool(found)
        if self.ready:
            self.machine.make_automaton()

    def candidates(self, text: str) -> list[tuple[int, int, int]]:
        """(item, from, to): stretches of the text that may hold an item within its budget."""
        seen: dict[tuple[int, int], list[int]] = {}
        for last, (size, places) in self.machine.iter(text):
            for n, at, other, before in places:
                if before:
                    begin = last + 1 - size
                    if not one_edit(other[::-1], text[max(0, begin - len(other) - 1) : begin][::-1]):
                        continue
                elif not one_edit(other, text[last + 1 : last + 2 + len(other)]):
                    continue
                k = self.items[n][2]
                start = last + 1 - size - at
                box = seen.setdefault((n, start // (k + 1)), [start, start])
                box[0], box[1] = min(box[0], start), max(box[1], start)
        out = []
        for (n, _), (a, b) in seen.items():
            _, item, k = self.items[n]
            out.append((n, max(0, a - k), min(len(text), b + len(item) + k)))
        return out

    def portions(self, jobs: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
        """Jobs (text, item, from, to) of about one size in lists whose tables fit DISTANCE_BYTES, or single ones."""
        part, words, letters, width = [], 0, 0, 0
        for job in sorted(jobs, key=lambda j: (len(self.items[j[1]][1]), j[3] - j[2])):
            _, n, a, b = job
            size = ((len(self.items[n][1]) + 63) // 64, self.letters[n], b - a)
            words, letters, width = max(words, size[0]), max(letters, size[1]), max(width, size[2])
            if part and (len(part) + 1) * (8 * words * (letters + 4) + 24 * width) > DISTANCE_BYTES:
                yield part
                part, (words, letters, width) = [], size
            part.append(job)
        if part:
            yield part

    def matches(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item id, distance, start, end) of the best passage of every item found, in normalised characters."""
        texts = [normalised(t) for t in texts]
        jobs = [(d, *c) for d, t in enumerate(texts) if self.ready and t for c in self.candidates(t)]
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        for part in self.portions(jobs):
            dist, end = myers([self.items[n][1] for _, n, _, _ in part], [texts[d][a:b] for d, _, a, b in part])
            for (d, n, a, _), x, e in zip(part, dist.tolist(), end.tolist(), strict=True):
                item_id, item, k = self.items[n]
                if x <= k:
                    got = (x, max(0, a + e - len(item)), a + e)
                    best[d][n] = min(best[d].get(n, got), got)
        return [[(self.items[n][0], *best_n) for n, best_n in sorted(b.items())] for b in best]


_MATCHERS: dict[tuple, Matcher] = {}


def matcher(block: list[tuple[int, str]], rate: float) -> Matcher:
    """The machine of a block, kept by the worker for its next task."""
    key = (rate, len(block), sha256(repr(block).encode("utf-8", "surrogatepass")).digest())
    if key not in _MATCHERS:
        _MATCHERS.clear()  # one block's machine at a time
        _MATCHERS[key] = Matcher(block, rate)
    return _MATCHERS[key]


def myers(patterns: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each pattern to any passage of its text, and where that passage ends.

    Column by column with one bit for each row of the table; long patterns take several 64-bit words,
    and the horizontal differences carry from word to word. All pairs advance together.
    """
    n, words = len(patterns), max((len(p) + 63) // 64 for p in patterns)
    m = np.array([len(p) for p in patterns])
    width = max(map(len, texts), default=0)
    codes = np.zeros((n, width), np.uint32)
    sizes = np.array([len(t) for t in texts])
    for i, t in enumerate(texts):
        codes[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    # peq[i]: for each character of pattern i the words of its positions; column 0 stands for other characters
    tables = []
    for p in patterns:
        t: dict[int, int] = {}
        for j, c in enumerate(p):
            t[ord(c)] = t.get(ord(c), 0) | 1 << j
        tables.append(t)
    letters = max(map(len, tables)) + 1
    peq, place = np.zeros((n, letters, words), np.uint64), np.zeros((n, width), np.int64)
    for i, t in enumerate(tables):
        keys = np.array(sorted(t), np.uint32)
        raw = b"".join(t[int(c)].to_bytes(8 * words, "little") for c in keys)
        peq[i, 1 : len(keys) + 1] = np.frombuffer(raw, np.uint64).reshape(len(keys), words)
        at = np.minimum(np.searchsorted(keys, codes[i]), len(keys) - 1)
        place[i] = np.where(keys[at] == codes[i], at + 1, 0)
    full = ~np.uint64(0)
    pv, mv = np.full((words, n), full), np.zeros((words, n), np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    last_word, last_bit = (m - 1) // 64, ((m - 1) % 64).astype(np.uint64)
    score = m.astype(np.int64).copy()
    best, end, rows = score.copy(), np.zeros(n, np.int64), np.arange(n)
    for j in range(width):
        carry_p, carry_m = np.zeros(n, np.uint64), np.zeros(n, np.uint64)  # row 0 is all zero: a passage starts anywhere
        eqs = peq[rows, place[:, j]]
        for w in range(words):
            eq, p, q = eqs[:, w], pv[w], mv[w]
            xv = eq | q
            eq = eq | carry_m
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = q | ~(xh | p), p & xh
            here = last_word == w
            if here.any():
                delta = (ph >> last_bit & one).astype(np.int64) - (mh >> last_bit & one).astype(np.int64)
                score += np.where(here, delta, 0)
            next_p, next_m = ph >> top, mh >> top
            ph, mh = ph << one | carry_p, mh << one | carry_m
            pv[w], mv[w] = mh | ~(xv | ph), ph & xv
            carry_p, carry_m = next_p, next_m
        better = (score < best) & (j < sizes)
        best[better], end[better] = score[better], j + 1
    return best, end


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of at most size characters (or one item), read bit by bit."""
    block, used = [], 0
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        text = normalised(text)
        if block and used + len(text) > size:
            yield block
            block, used = [], 0
        block.append((item_id, text))
        used += len(text)
    if block:
        yield block


SCHEMA = "doc_id long, item_id long, distance int, start int, end int"


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document and item found in it: doc_id, item_id, distance, start, end (of the best passage, in normalised characters)."""
    rows, out = keyed_texts(docs, id_col, text_col), None
    for block in blocks(benchmark):

        def run(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            found_by = matcher(block, rate)
            for batch in batches:
                for part in slices(batch, 256):
                    ids, found = part.column(0).to_pylist(), found_by.matches(part.column(1).to_pylist())
                    flat = [(i, *x) for i, f in zip(ids, found, strict=True) for x in f]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], pa.int64() if c < 2 else pa.int32()) for c in range(5)], names=["doc_id", "item_id", "distance", "start", "end"])

        got = rows.mapInArrow(run, SCHEMA)
        out = got if out is None else out.unionAll(got)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; every block is one more pass without a shuffle."""
    at, schema = docs.columns.index("text"), docs.schema
    for block in blocks(benchmark):

        def run(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            found_by = matcher(block, rate)
            for batch in batches:
                for part in slices(batch, 256):
                    found = found_by.matches([t or "" for t in part.column(at).to_pylist()])
                    yield part.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
