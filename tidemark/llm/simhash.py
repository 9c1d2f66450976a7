"""SimHash near-duplicates by bit-sliced comparison (operator 4).

Fingerprints that differ in at most RADIUS bits are linked. Distinct fingerprints
are dealt to buckets that agree in three of RADIUS + 3 bit blocks: two linked ones
agree in at least one such choice. Inside a bucket the fingerprints stand vertically,
one integer per bit position; a carry-save counter adds the differing planes of one
query to all members at once and gives up as soon as every member exceeds the radius.
Each member is a query once and is reached once, so a bucket of m gives at most
m - 1 links, never all pairs.

A bucket of more than BUCKET fingerprints, which a count finds before any is dealt, goes another exact way: two fingerprints
are within distance 2 just when they share a word within distance 1 of both, so each
is listed under its 65 such words and linked to the least one listed there.

Defined cases: null or empty text, or white space only, has fingerprint zero, linked like
any other; equal fingerprints are one node; a null doc_id is linked but never
names a component (null if it has no other id); repeated rows keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, one_of_each, per_text, stored
from .graph import components

RADIUS, SHINGLE, SEED, BUCKET = 2, 3, 42, 4096
MASK = (1 << 64) - 1


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The SimHash of the text's shingles, repeats included."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) < width:
        return hashed(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    return majority(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8"))


def majority(h: np.ndarray) -> int:
    """The word whose bits are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a long); keyed: also row, the hash of the text as one_of_each takes it."""

    def make():
        def work(ids: list, texts: list) -> dict[str, list]:
            found = {"doc_id": ids, "fp": [signed(fingerprint(t)) for t in texts]}
            return found | {"row": [signed(xxhash.xxh64_intdigest(t.encode("utf-8"), SEED)) for t in texts]} if keyed else found

        return work

    return per_text(keyed_texts(docs, id_col, text_col), make, "doc_id long, fp long" + ", row long" * keyed)


def block_masks(radius: int) -> list[int]:
    """A mask for each choice of three of radius + 3 blocks."""
    edges = [round(64 * i / (radius + 3)) for i in range(radius + 4)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(blocks, 3)]


class Planes:
    """Fingerprints stood vertically: one integer for each bit position, with a bit for each member."""

    def __init__(self, members: list[int], free: Sequence[int] = range(64)):
        self.free, self.everyone = free, (1 << len(members)) - 1
        rows = np.unpackbits(np.array(members, "<u8").view(np.uint8).reshape(len(members), 8), axis=1, bitorder="little")
        packed = np.packbits(rows[:, list(free)].T, axis=1, bitorder="little")
        self.planes = [int.from_bytes(p.tobytes(), "little") for p in packed]

    def near(self, q: int, radius: int, left: int) -> int:
        """Members of `left` within the radius of q: carry-save counters add one differing plane after the other, until all are over it."""
        counts = [0] * (radius.bit_length() + 1)  # counts[k]: bit k of every member's distance; the last one sticks
        over, every = 0, max(1, radius // 2)
        for at, (b, plane) in enumerate(zip(self.free, self.planes, strict=True), 1):
            carry = plane ^ self.everyone if q >> b & 1 else plane
            for k in range(len(counts)):
                if not carry:
                    break
                counts[k], carry = counts[k] ^ carry, counts[k] & carry
            over |= carry
            if at % every == 0:
                over |= exceeds(counts, radius, self.everyone)
                if over & left == left:
                    return 0
        return left & ~(over | exceeds(counts, radius, self.everyone))


def bits(mask: int) -> Iterator[int]:
    """Positions of the bits that are set."""
    while mask:
        yield (mask & -mask).bit_length() - 1
        mask &= mask - 1


def bucket_links(members: list[int], free: Sequence[int], radius: int) -> Iterator[tuple[int, int, int]]:
    """Places (root, near, member) of links that connect all members of a bucket that chains of close pairs connect.

    members: distinct 64-bit words; free: bit positions in which they may differ; member is within the radius of near, and of root by a chain.
    """
    planes = Planes(members, free)
    left = planes.everyone
    while left:
        root = (left & -left).bit_length() - 1
        left ^= 1 << root
        queue = [root]
        while queue and left:
            at = queue.pop()
            near = planes.near(members[at], radius, left)
            left ^= near
            for i in bits(near):
                queue.append(i)
                yield root, at, i


def exceeds(counts: list[int], radius: int, everyone: int) -> int:
    """Members whose counter is over the radius, compared bit by bit from the top."""
    over, equal = 0, everyone
    for k in range(len(counts) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counts[k]
        else:
            over |= equal & counts[k]
            equal &= ~counts[k]
    return over


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """distinct: fp (long, each once). Returns a, b: links that join all fingerprints within the radius, by chains."""
    masks = block_masks(radius)
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks)])
    listed = distinct.select("fp", F.explode(keys).alias("x")).select("x.t", "x.k", "fp")
    full = stored(listed.groupBy("t", "k").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("t", "k"), "full-buckets")
    large = None
    if not full.isEmpty():  # counted here, so that no task meets such a bucket
        large = listed.join(full, ["t", "k"], "left_semi").select("fp").distinct()
        listed = listed.join(full, ["t", "k"], "left_anti")
    dealt = listed.repartition("t", "k").sortWithinPartitions("t", "k")

    def flush(t: int, members: np.ndarray, out: list) -> None:
        if len(members) > 1:
            words = [int(x) & MASK for x in members]
            out += [(signed(words[a]), signed(words[b])) for a, _, b in bucket_links(words, free[t], radius)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rest = None, []
        for batch in batches:
            t, k, fp = (batch.column(i).to_numpy() for i in range(3))
            if not len(t):
                continue
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts, out = [0, *cut.tolist()], []
            for a, b in zip(starts, [*cut.tolist(), len(t)], strict=True):
                key = (int(t[a]), int(k[a]))
                if key != last:
                    if last:
                        flush(last[0], np.concatenate(rest), out)
                    last, rest = key, []
                rest.append(fp[a:b])
            yield rows(out)
        if last:
            flush(last[0], np.concatenate(rest), out := [])
            yield rows(out)

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    found = stored(dealt.mapInArrow(run, "a long, b long").distinct(), "links")
    return found if large is None else found.unionAll(shared_words(large, radius))


def shared_words(fps: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints that share a word within half the radius of both; exact for radius 2."""
    if radius != 2:
        raise ValueError("the way for large buckets is made for radius 2")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)) for b in range(64)])
    listed = fps.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("word"))
    least = listed.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return listed.join(least, "word").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links) for every row of docs."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fp"), radius, bucket))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component, that of the least doc_id (null last); rows of one doc_id with other texts are decided each for itself.

    Without a similarity, fingerprints of the query's kind link within RADIUS. With one (0.8 is what near_copies is made for), texts link whose sets of
    five-word shingles are that similar: no split by blocks reaches so far, so that near_copies deals the buckets and confirms what the
    bit-sliced comparison proposes.
    """
    if similarity is not None:
        from . import near_copies

        return near_copies.keep_one(docs, similarity)
    prints = stored(fingerprints(docs, keyed=True), "fingerprints")
    roots = components(links(prints.select("fp").distinct()))
    return one_of_each(docs, prints.select("doc_id", "row", F.col("fp").alias("node")), roots)
