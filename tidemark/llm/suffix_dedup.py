"""Repeated-passage removal by a depth-limited most-significant-digit radix sort of suffixes (operator 2).

A suffix matters here only through its first DEPTH bytes. Suffixes are ordered digit by digit and a group
of one is never looked at again, so that what is left at depth DEPTH are exactly the repeated
windows. The first digit of a suffix is its minimizer: the least hash of the KEY-byte strings in its
first DEPTH bytes, which depends on those bytes alone. Neighbouring suffixes mostly share it, so the
suffixes of a text travel as runs ("chunks") of about a dozen:

1. Each text is cut into chunks; a chunk's key (minimizer) and a digest of all its bytes go to the bucket
   of the key's high bits, packed by the block of documents. There the keys are sorted digit by digit.
   Chunks that are equal as a whole repeat all their suffixes: every one but those of the least
   document is covered. Keys that stand in one document only end here.
2. Only the chunks that are left in a shared key (they differ in some byte, typically at the ends of copied
   passages) send their bytes to a second shuffle, where their single suffixes are sorted by the
   bytes themselves, eight at a time, to depth DEPTH.
3. The covered suffixes come back to their documents, and the bytes that they cover are removed.

Every block of documents keeps only the least document of equal chunks before the shuffle. A key that a sample of the
documents finds in more chunks than a quarter of a bucket is hot: its chunks are dealt by key and digest, so that no bucket has to hold them
all, and what is left of them goes to stage 2 without a look at the others. There the chunks of hot keys, and of keys with
more than HOT different chunks in a bucket, are dealt by the hash of each single suffix instead of by the key, again
reduced to the least document of a block first: a passage in a third of all documents costs a
row for each block. The sample decides only which way chunks go, never what is found. Whole chunks are compared by at least 80 bits of two hashes (the bucket adds more as the data
grows), single suffixes byte by byte.

Defined cases: a null text is empty; texts shorter than DEPTH bytes keep everything; a null doc_id counts as
greater than any other; rows that repeat a doc_id are no copies of each other, since none has the
smaller id; very long texts are hashed in stretches; matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, slices, stored

DEPTH, KEY = 50, 20
#: Different chunks of one key beyond which its suffixes are dealt one by one.
HOT = 20_000
#: Bytes of documents that one block packs together; of text for a bucket at most, and at least where that gives no SPREAD buckets; of a text that one numpy pass hashes.
BLOCK_BYTES, BUCKET_BYTES, LEAST_BYTES, STRETCH = 8 << 20, 16 << 20, 512 << 10, 256 << 10
SPREAD = 128
#: One document of so many is looked at for hot keys; the most hot keys that are told to the workers; bytes of text for each chunk, about.
SAMPLED, HOT_KEYS, CHUNK_BYTES = 64, 100_000, 12
NO_ID = (1 << 63) - 1
U = np.uint64
M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)
COVERED, SHARED, STARTS = 0, 1, 2
HOT_BIT = np.uint32(1 << 31)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * M1
    return x ^ x >> U(29)


def gram_hashes(x: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all strings of each size (in bytes), built from those of half the size."""
    powers, p = {1: mix(x.astype(np.uint64) + U(1))}, 1
    while 2 * p <= max(sizes):
        h = powers[p]
        powers[2 * p] = mix(h[: len(h) - p] * M2 + h[p:])
        p *= 2
    out = []
    for size in sizes:
        n, at, got = len(x) - size + 1, 0, None
        for bit in (1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1):
            part = powers[bit][at : at + n]
            got = part if got is None else mix(got * M2 + part)
            at += bit
        out.append(got)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    r, p = x, 1
    while 2 * p <= width:
        r = np.minimum(r[: len(r) - p], r[p:])
        p *= 2
    return np.minimum(r[: len(r) - (width - p)], r[width - p :]) if p < width else r


class Chunks:
    """Runs of suffixes of one text: key, digest, first and last start."""

    def __init__(self, x: np.ndarray, stretch: int = STRETCH, hashes: bool = False):
        width, n = DEPTH - KEY + 1, len(x) - DEPTH + 1
        keys, digests, firsts, lasts, self.window = [], [], [], [], []
        for lo in range(0, n, stretch):
            y = x[lo : min(lo + stretch, n) + DEPTH - 1]
            grams, whole = gram_hashes(y, (KEY, DEPTH))
            least = sliding_min(grams, width)
            cut = np.flatnonzero(least[1:] != least[:-1]) + 1
            first = np.concatenate([[0], cut])
            length = np.diff(np.append(first, len(least)))
            if (reps := (length - 1) // width + 1).max(initial=1) > 1:  # a run of equal keys longer than a window
                turn = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                last = np.repeat(first + length, reps)
                first = np.repeat(first, reps) + turn * width
                length = np.minimum(last - first, width)
            last = first + length - 1
            keys.append(mix(least[first]))  # least hashes are small; mixed, they fill all buckets alike
            digests.append((mix(whole[first] * U(3) + whole[last] * U(7) + length.astype(np.uint64)) >> U(32)).astype(np.uint32))
            firsts.append(first + lo)
            lasts.append(last + lo)
            if hashes:
                self.window.append(whole)
        cat = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        self.keys, self.digests = cat(keys, np.uint64), cat(digests, np.uint32)
        self.first, self.last = cat(firsts, np.int64), cat(lasts, np.int64)
        self.window = cat(self.window, np.uint64)


def shuffled(a: np.ndarray) -> bytes:
    """Bytes of an integer array, all lowest bytes first, so that zstd finds the zeros."""
    return a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def unshuffled(raw: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel()


def packed(doc: np.ndarray, tag: np.ndarray, columns: list[tuple[np.ndarray, bool]], tail: bytes = b"") -> bytes:
    """One blob of rows in document order. columns: unsigned arrays, each with whether it compresses; tail: bytes as they are."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    meta = squeeze(shuffled(np.diff(doc, prepend=0)) + shuffled(tag) + b"".join(shuffled(c) for c, small in columns if small))
    raw = b"".join(c.tobytes() for c, small in columns if not small)
    rest = squeeze(tail) if tail else b""
    return np.array([len(doc), len(meta), len(tail), len(rest)], "<u4").tobytes() + meta + raw + rest


def unpacked(blob: bytes, columns: list[tuple[str, bool]]) -> tuple[list[np.ndarray], bytes]:
    """Document, tag and the columns (dtype, compressed or not) of a blob, and its tail."""
    n, m, t, r = np.frombuffer(blob, "<u4", 4).tolist()
    loose = zstandard.ZstdDecompressor().decompress
    meta, at, raw_at = loose(blob[16 : 16 + m]), 0, 16 + m
    out = []
    for dtype, small in [("<i8", True), ("<i8", True), *columns]:
        size = n * np.dtype(dtype).itemsize
        if small:
            out.append(unshuffled(meta[at : at + size], dtype, n))
            at += size
        else:
            out.append(np.frombuffer(blob, dtype, n, raw_at))
            raw_at += size
    out[0] = np.cumsum(out[0])
    return out, loose(blob[raw_at : raw_at + r]) if t else b""


def blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows (doc_id, tag, text bytes, ...) in blocks of about size bytes, least doc_id first."""
    rows, used = [], 0
    for batch in batches:
        for part in slices(batch, 256):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                row = (row[0], row[1], row[2].encode("utf-8", "surrogatepass"), *row[3:])
                rows.append(row)
                used += len(row[2])
                if used >= size:
                    yield sorted(rows, key=lambda r: r[:2])
                    rows, used = [], 0
    if rows:
        yield sorted(rows, key=lambda r: r[:2])


def by_document(doc: np.ndarray, tag: np.ndarray, values: np.ndarray, kind: int, bucket: int = 0) -> pa.RecordBatch:
    """A row for each document with its values (unsigned, in order) as bytes."""
    order = np.lexsort((values & ~HOT_BIT, tag, doc))
    doc, tag, values = doc[order], tag[order], values[order].astype("<u4")
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) if len(doc) else np.zeros(0, np.int64)
    offsets = (np.append(first, len(doc)) * 4).astype("<i4")
    data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
    n = len(first)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), pa.array(doc[first], pa.int64()), pa.array(tag[first], pa.int64()), data], names=["kind", "doc", "tag", "data"])


FOUND = "kind int, doc long, tag long, data binary"
DEALT = "bucket int, kind int, doc long, tag long, data binary"


def dealt(bucket: np.ndarray, make) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) for each bucket; make(rows) packs the rows of one, which stay in document order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cut):
        if len(rows):
            yield int(bucket[rows[0]]), make(rows)


def with_bucket(found: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """What a block has settled itself passes the shuffle under a bucket below zero, by document."""
    bucket = -1 - (found.column(1).to_numpy() & 0x7FFFFFFF) % buckets
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *found.columns], names=["bucket", "kind", "doc", "tag", "data"])


def blob_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    none = pa.array([None] * n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([None] * n, pa.int32()), none, none, pa.array([x for _, x in rows], pa.binary())], names=["bucket", "kind", "doc", "tag", "data"])


def first_of_equal(keys: np.ndarray, same: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a row (in document order) stands in the least document among rows of its key; `same` confirms that keys are equal."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    least = first[inverse]
    return (doc == doc[least]) | (same != same[least])


def key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, by its high bits; fewer than 2^31 buckets."""
    return ((keys >> U(33)) * U(buckets) >> U(31)).astype(np.int32)


def held(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each key is among the hot ones (sorted)."""
    if not len(hot):
        return np.zeros(len(keys), bool)
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys


LOW = U((1 << 48) - 1)


def common_keys(block: int, stretch: int):
    """By block of documents: keys with the number of their chunks, those that occur again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, block):
            keys, n = np.unique(np.concatenate([Chunks(np.frombuffer(t, np.uint8), stretch).keys for _, _, t in rows]), return_counts=True)
            some = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some])], names=["key", "n"])

    return run


def hot_keys(core: DataFrame, size: int, block: int, stretch: int, sampled: int = SAMPLED) -> np.ndarray:
    """Keys that more chunks have than a quarter of a bucket of `size` bytes of text, as a sample of documents tells; the most frequent HOT_KEYS at most."""
    some = core.filter(F.pmod(F.xxhash64("doc", "tag"), F.lit(sampled)) == 0)
    counts = some.mapInArrow(common_keys(block, stretch), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    least = max(2, size // CHUNK_BYTES // 4 // sampled)
    found = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").collect()
    return np.sort(np.array([r.key for r in found], np.int64).view(np.uint64))


def refine(rows: np.ndarray, group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: splits groups by the next digit (digit[i] of rows[i]) and drops groups of one."""
    order = np.lexsort((digit, group))
    rows, group, digit = rows[order], group[order], digit[order]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]) if len(rows) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    keep = np.bincount(group)[group] > 1 if len(rows) else new
    return rows[keep], group[keep]


def least_by(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, NO_ID)
    np.minimum.at(out, group, value)
    return out


def cut_chunks(buckets: int, block: int, stretch: int, hot: np.ndarray):
    """Stage 1, by block of documents: packed (key, digest, number in its text) of every chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, block):
            made = [Chunks(np.frombuffer(t, np.uint8), stretch) for _, _, t in rows]
            sizes = [len(c.keys) for c in made]
            if not sum(sizes):
                continue
            keys, digests = np.concatenate([c.keys for c in made]), np.concatenate([c.digests for c in made])
            doc, tag = (np.repeat(np.array([r[i] for r in rows], np.int64), sizes) for i in (0, 1))
            number = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
            del made
            kept = first_of_equal(keys ^ digests.astype(np.uint64) * M2, keys, doc)
            if not kept.all():
                yield with_bucket(by_document(doc[~kept], tag[~kept], number[~kept], COVERED), buckets)
            doc, tag, number, keys, digests = (a[kept] for a in (doc, tag, number, keys, digests))
            low = keys.view(np.uint8).reshape(-1, 8)
            pack = lambda rows: packed(doc[rows], tag[rows], [(number[rows], True), (digests[rows], False)]) + np.ascontiguousarray(low[rows, :6]).tobytes()  # noqa: E731, B023
            dealt_by = np.where(held(keys, hot), mix(keys ^ digests.astype(np.uint64) * M2), keys)
            yield blob_rows(list(dealt(key_bucket(dealt_by, buckets), pack)))

    return run


def equal_chunks(key: tuple, table: pa.Table, hot: int, hot_low: np.ndarray) -> pa.Table:
    """Stage 1, by bucket: covered chunks, and the chunks left in keys of several documents. hot_low: the low bits of hot keys, sorted; they count as keys of several."""
    schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("tag", pa.int64()), ("data", pa.binary())])
    if key[0].as_py() < 0:
        return table.select(["kind", "doc", "tag", "data"])
    parts = []
    for blob in table.column("data").to_pylist():
        n = int.from_bytes(blob[:4], "little")
        got, _ = unpacked(blob[: len(blob) - 6 * n], [("<u4", True), ("<u4", False)])
        low = np.zeros((n, 8), np.uint8)
        low[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, len(blob) - 6 * n).reshape(n, 6)
        parts.append([*got, low.view("<u8").ravel()])
    doc, tag, number, digest, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts, table
    rows, group = np.arange(len(doc)), np.zeros(len(doc), np.int64)
    spread = held(keys, hot_low)
    lone = np.flatnonzero(spread)  # a hot key's only chunk here still has others elsewhere
    for shift in (32, 16, 0):
        rows, group = refine(rows, group, (keys[rows] >> U(shift) & U(0xFFFF)).astype(np.uint16))
    lone = np.setdiff1d(lone, rows, assume_unique=True)
    rows, group = np.concatenate([rows, lone]), np.concatenate([group, (group.max() + 1 if len(group) else 0) + np.arange(len(lone))])
    if not len(rows):
        return schema.empty_table()
    d = doc[rows]
    order = np.lexsort((digest[rows], group))
    rows, group, d = rows[order], group[order], d[order]
    g = digest[rows]
    chunk = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (g[1:] != g[:-1])])) - 1
    covered = d > least_by(chunk, d, chunk[-1] + 1)[chunk]
    left, group = rows[~covered], group[~covered]
    _, group = np.unique(group, return_inverse=True)
    n = group.max() + 1
    several = least_by(group, doc[left], n) < -least_by(group, -doc[left], n)
    size = np.bincount(group, minlength=n)
    values = number[left] | np.where((size[group] > hot) | spread[left], HOT_BIT, np.uint32(0))
    shared = several[group] | spread[left]
    out = [by_document(doc[rows[covered]], tag[rows[covered]], number[rows[covered]], COVERED), by_document(doc[left[shared]], tag[left[shared]], values[shared], SHARED)]
    return pa.Table.from_batches(out, schema)


def send_bytes(buckets: int, block: int, stretch: int):
    """Stage 2, by block of documents with shared chunks (fourth column): the bytes of those chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, block):
            doc, tag, start, count, salt, texts = ([] for _ in range(6))
            hot: list[tuple] = []
            for d, t, text, lists in rows:
                want = np.frombuffer(b"".join(lists), "<u4")
                alone = (want & HOT_BIT) > 0
                c = Chunks(np.frombuffer(text, np.uint8), stretch, hashes=bool(alone.any()))
                at = want & ~HOT_BIT
                i = at[~alone]
                doc.append(np.full(len(i), d))
                tag.append(np.full(len(i), t))
                start.append(c.first[i])
                count.append(c.last[i] - c.first[i] + 1)
                salt.append(c.keys[i])
                texts += [text[a : b + DEPTH] for a, b in zip(c.first[i].tolist(), c.last[i].tolist(), strict=True)]
                if alone.any():
                    s = np.concatenate([np.arange(a, b + 1) for a, b in zip(c.first[at[alone]].tolist(), c.last[at[alone]].tolist(), strict=True)])
                    hot.append((d, t, s, c.window[s], text))
            doc, tag, start, count, salt = (np.concatenate(x).astype(k) for x, k in ((doc, "<i8"), (tag, "<i8"), (start, "<u4"), (count, "<u4"), (salt, "<u8")))
            if hot:
                hd, ht = (np.concatenate([np.full(len(h[2]), h[i]) for h in hot]) for i in (0, 1))
                hs, hw = np.concatenate([h[2] for h in hot]).astype("<u4"), np.concatenate([h[3] for h in hot])
                raw = [h[4][s : s + DEPTH] for h in hot for s in h[2].tolist()]
                same = np.array([hash(x) for x in raw], np.int64)
                kept = first_of_equal(hw, same, hd)
                if not kept.all():
                    yield with_bucket(by_document(hd[~kept], ht[~kept], hs[~kept], STARTS), buckets)
                doc, tag, start = np.append(doc, hd[kept]), np.append(tag, ht[kept]), np.append(start, hs[kept])
                count, salt = np.append(count, np.ones(int(kept.sum()), "<u4")).astype("<u4"), np.append(salt, mix(hw[kept]))
                texts += [x for x, k in zip(raw, kept.tolist(), strict=True) if k]
            if not len(doc):
                continue
            order = np.lexsort((tag, doc))
            doc, tag, start, count, salt, texts = doc[order], tag[order], start[order], count[order], salt[order], [texts[i] for i in order.tolist()]
            pack = lambda rows: packed(doc[rows], tag[rows], [(start[rows], True), (count[rows], True)], b"".join(texts[i] for i in rows.tolist()))  # noqa: E731, B023
            yield blob_rows(list(dealt(key_bucket(salt, buckets), pack)))

    return run


def equal_suffixes(key: tuple, table: pa.Table) -> pa.Table:
    """Stage 2, by bucket: single suffixes sorted by their bytes to DEPTH; those of a document that is not the least of its group."""
    schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("tag", pa.int64()), ("data", pa.binary())])
    if key[0].as_py() < 0:
        return table.select(["kind", "doc", "tag", "data"])
    parts = [unpacked(blob, [("<u4", True), ("<u4", True)]) for blob in table.column("data").to_pylist()]
    doc, tag, start, count = (np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True))
    raw = np.frombuffer(b"".join(p[1] for p in parts) + bytes(8), np.uint8)
    del parts, table
    count = count.astype(np.int64)
    length = count + DEPTH - 1
    entry = np.repeat(np.arange(len(count)), count)
    turn = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    place = (np.cumsum(length) - length)[entry] + turn
    words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    rows, group = np.arange(len(entry)), np.zeros(len(entry), np.int64)
    for at in [*range(0, DEPTH - 8, 8), DEPTH - 8]:
        rows, group = refine(rows, group, words[place[rows] + at].astype(np.uint64))
    if not len(rows):
        return schema.empty_table()
    _, group = np.unique(group, return_inverse=True)
    d = doc[entry[rows]]
    rows = rows[d > least_by(group, d, group.max() + 1)[group]]
    e = entry[rows]
    return pa.Table.from_batches([by_document(doc[e], tag[e], (start[e] + turn[rows]).astype(np.uint32), STARTS)], schema)


def kept_and_removed(text: bytes, numbers: list[bytes], starts: list[bytes], stretch: int) -> tuple[bytes, list[int], list[int]]:
    """The bytes that stay, and where the removed runs start and end."""
    marks = np.zeros(len(text) + 1, np.int32)
    if numbers:
        c, i = Chunks(np.frombuffer(text, np.uint8), stretch), np.frombuffer(b"".join(numbers), "<u4")
        np.add.at(marks, c.first[i], 1)
        np.add.at(marks, c.last[i] + DEPTH, -1)
    if starts:
        s = np.frombuffer(b"".join(starts), "<u4").astype(np.int64)
        np.add.at(marks, s, 1)
        np.add.at(marks, s + DEPTH, -1)
    gone = np.cumsum(marks[:-1]) > 0
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def tagged(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """doc (null: the greatest), tag (tells rows of one doc_id apart by their text; 0 where ids are unique), text and further columns."""
    rows = keyed_texts(docs)
    unique = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    return named.select("doc", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("tag"), "text", *extra)


def remove_repeats(docs: DataFrame, extra: list[str] = (), as_text: bool = False, hot: int = HOT, block: int = BLOCK_BYTES, stretch: int = STRETCH, sampled: int = SAMPLED) -> DataFrame:
    """Every row: doc_id, n_bytes, kept, starts and ends (of the maximal removed runs, in bytes), the extra columns.

    kept holds the bytes that stay or, as_text, a string without the characters that lost some of their bytes.
    """
    rows = tagged(docs, list(extra))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(BUCKET_BYTES, max(LEAST_BYTES, total // SPREAD))
    buckets = int(min(max(1, -(-total // size)), (1 << 31) - 1))
    core = rows.select("doc", "tag", "text")
    common = hot_keys(core, size, block, stretch, sampled)
    low = np.unique(common & LOW)
    found = stored(core.mapInArrow(cut_chunks(buckets, block, stretch, common), DEALT).groupBy("bucket").applyInArrow(lambda k, t: equal_chunks(k, t, hot, low), FOUND), "chunks")
    shared = found.filter(F.col("kind") == SHARED).groupBy("doc", "tag").agg(F.collect_list("data").alias("shared")).hint("shuffle_hash")
    sent = rows.join(shared, ["doc", "tag"]).select("doc", "tag", "text", "shared").mapInArrow(send_bytes(buckets, block, stretch), DEALT)
    single = sent.groupBy("bucket").applyInArrow(equal_suffixes, FOUND)
    covered = found.filter(F.col("kind") == COVERED).unionAll(single)
    lists = covered.groupBy("doc", "tag").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("data"))).alias(n) for k, n in ((COVERED, "numbers"), (STARTS, "singles"))]).hint("shuffle_hash")
    joined = rows.join(lists, ["doc", "tag"], "left").select("doc", "text", "numbers", "singles", *extra)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["doc_id long", "n_bytes long", "kept string" if as_text else "kept binary", "starts array<long>", "ends array<long>", *(f"`{c}` {kinds[c]}" for c in extra)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, numbers, singles in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    out.append((len(raw), *(kept_and_removed(raw, numbers or [], singles or [], stretch) if numbers or singles else (raw, [], []))))
                if as_text:
                    out = [(n, kept.decode("utf-8", "ignore"), *spans) for n, kept, *spans in out]
                ids = pa.array([None if i == NO_ID else i for i in part.column(0).to_pylist()], pa.int64())
                made = [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.string() if as_text else pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([ids, *made, *part.columns[4:]], names=["doc_id", "n_bytes", "kept", "starts", "ends", *extra])

    return joined.mapInArrow(run, schema)


def described(found: DataFrame) -> DataFrame:
    """Digest columns of remove_repeats."""
    removed = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda a, s: a + s["ends"] - s["starts"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages cut out of text; a character that loses some of its bytes goes whole. n_chars, where there is one, counts anew."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    plain = {c: f"_extra_{i}" for i, c in enumerate(others)}  # whatever the extra columns are called
    cut = remove_repeats(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in plain.items()]), list(plain.values()), as_text=True)
    kinds = {f.name: f.dataType for f in docs.schema}
    made = {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.col("kept"), "n_chars": F.length("kept").cast(kinds.get("n_chars", "long")), **{c: F.col(n) for c, n in plain.items()}}
    return cut.select(*[made[c].alias(c) for c in docs.columns])
