"""SimHash near-duplicates at a similarity of 0.8 of five-word shingles (the pipeline's form of operator 4).

Two texts are linked if the Jaccard similarity of their sets of SHINGLE-word shingles is at least 0.8. At 0.8 the SimHash fingerprints of the sets differ
in about ten of 64 bits (standard deviation three), which blocks of equal bits cannot split. So buckets are dealt by MinHash: texts meet if they share one
of BANDS keys, each made of ROWS minima of the set under fixed permutations; a pair at 0.8 exactly is missed with probability
(1 - 0.8^6)^40 = 5e-6, more similar ones less often. Inside a bucket the fingerprints are compared bit-sliced (simhash.Planes), and
what they propose is confirmed on the whole sets, so that no link is a guess.

1. Every bucket is linked by chains of fingerprints within NEAR bits, fewer links than it has members; FIRST of each text's are confirmed.
   A bucket of more than BLOCK texts is dealt in blocks by hash, each with the bucket's least text.
2. Buckets that still hold several components are gone through again: members outside the bucket's largest component are compared
   with all of other components within FAR bits (five standard deviations). Such a pair has to be
   confirmed only if at least AGREE of its ROWS * BANDS minima agree, by a byte of each (192 on average at 0.8, standard deviation six), and only in the
   first of the buckets that it shares. No pair leaves its bucket before that: the bucket names the texts that have one, their sets are
   dealt to it, and there the same pairs are counted on the whole sets. What comes out are links that join components, fewer than a block has members.

So a large group costs a pass of each member over its planes and a row for each of its buckets that asks for its set; the comparisons inside a
block still grow with the square of its members that the first pass leaves apart. None is capped. The sketches' miss is again below 1e-6 at 0.8 exactly.

Defined cases: words as for the fingerprints (bytes, A-Z folded, ASCII white space); a text of fewer words is
one shingle; null, empty and white space only are equal to each other; equal sets are one node; rows that share a doc_id, null included, are
decided each by its text, rows that share both are one; other columns pass through whatever they are called; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keyed_texts, one_of_each, per_text, stored
from .graph import components
from .simhash import Planes, bits, bucket_links, majority, signed

SHINGLE, SEED, ROWS, BANDS = 5, 42, 6, 40
#: Bits within which the first pass proposes links, and the second; texts of a block of a bucket; ids that may be broadcast.
NEAR, FAR, BLOCK, FEW = 16, 26, 4096, 1_000_000
#: Neighbours of a text that the first pass confirms.
FIRST = 40
#: Minima that have to agree for a pair to be confirmed on its whole sets; 8-byte words of sets and sketches that a side of a block may hold.
AGREE, ROOM = 161, 1 << 21
_draw = np.random.default_rng(11)
FLIP = _draw.integers(0, 1 << 32, ROWS * BANDS, np.uint32)
FACTOR = _draw.integers(0, 1 << 32, ROWS * BANDS, np.uint32) | np.uint32(1)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - width)].tolist()]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, (ends[min(width, len(words)) - 1 :] - 1).tolist(), strict=True)], "<u8").view("<i8"))


def minima(found: np.ndarray) -> np.ndarray:
    """The least hash of a set under each permutation."""
    short = (found.view("<u8") >> np.uint64(32)).astype("<u4")
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, "<u4")
    for at in range(0, len(short), 512):
        np.minimum(least, ((short[at : at + 512, None] ^ FLIP) * FACTOR).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """The keys that a set's minima make."""
    raw = least.tobytes()
    return [signed(xxhash.xxh64_intdigest(raw[4 * ROWS * i : 4 * ROWS * (i + 1)], i)) for i in range(BANDS)]


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), node (digest of the set), fp (SimHash of the set), bands and sketch (the bands' keys, then a byte of each minimum) of every row; the empty set has no bands."""

    def make():
        def work(ids: list, texts: list) -> dict[str, list]:
            sets = [shingles(t) for t in texts]
            digest = lambda raw: signed(xxhash.xxh64_intdigest(raw, SEED))
            fps = [signed(majority(s.view("<u8"))) for s in sets]
            least = [minima(s) if len(s) else None for s in sets]
            keys = [[] if m is None else bands(m) for m in least]
            sketches = [None if m is None else np.array(k, "<i8").tobytes() + m.astype(np.uint8).tobytes() for m, k in zip(least, keys, strict=True)]
            return {"doc_id": ids, "row": [digest(t.encode("utf-8")) for t in texts], "node": [digest(s.tobytes()) for s in sets], "fp": fps, "bands": keys, "sketch": sketches}

        return work

    return per_text(keyed_texts(docs), make, "doc_id long, row long, node long, fp long, bands array<long>, sketch binary")


def shingle_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: node, row (each once). Returns node, shingles; only texts that are asked for are shuffled while rows are few."""
    few = F.broadcast(rows) if rows.count() <= FEW else rows
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    texts = texts.join(few, "row").dropDuplicates(["node"])

    def make():
        return lambda ids, texts: {"node": ids, "shingles": [shingles(t) for t in texts]}

    return per_text(texts.select("node", "text"), make, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets (node, shingles) are at least so similar."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    share = int(round(similarity * 1000))
    return both.filter((1000 + share) * shared >= share * total).select("a", "b")


def blocks(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The other columns of consecutive rows that share the first `keys` columns; rows come in their order."""
    last, held = None, []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns[:keys]:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns[:keys])
            if key != last:
                if held:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                last, held = key, []
            held.append([c[a:b] for c in columns[keys:]])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def block_rows(batches: Iterable[pa.RecordBatch], keys: int, find: Callable[..., Iterator[tuple[int, ...]]], names: str = "a b") -> Iterator[pa.RecordBatch]:
    """What find(columns of a block) gives, as rows of longs so named."""
    out: list[tuple[int, ...]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(len(names.split()))], names=names.split())

    for block in blocks(batches, keys):
        out += find(*block)
        if len(out) > 1 << 16:
            yield batch()
            out = []
    yield batch()


def chains(nodes: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """(near, node) for every member of a block that a chain of fingerprints within NEAR bits reaches."""
    ids = nodes.tolist()
    for _, near, i in bucket_links(fps.view("<u8").tolist(), range(64), NEAR):
        yield ids[near], ids[i]


def strangers(fps: np.ndarray, roots: np.ndarray, asks: np.ndarray, band: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places) for members that ask: members of other components within FAR bits whose sketches agree, if this is the first bucket that both share."""
    members, queries = np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)
    if not len(members):
        return
    words, planes = fps.view("<u8").tolist(), Planes(fps[members].view("<u8").tolist())
    own: dict[int, int] = {}
    for i, r in enumerate(roots[members].tolist()):
        own[r] = own.get(r, 0) | 1 << i
    table = np.frombuffer(b"".join(sketches[members].tolist()), np.uint8).reshape(len(members), 8 * BANDS + ROWS * BANDS)
    met, least = np.ascontiguousarray(table[:, : 8 * BANDS]).view("<i8"), table[:, 8 * BANDS :]
    for q in queries.tolist():
        places = np.fromiter(bits(planes.near(words[q], FAR, planes.everyone & ~own.get(int(roots[q]), 0))), np.int64)
        if len(places):
            first = (met[places] == np.frombuffer(sketches[q][: 8 * BANDS], "<i8")).argmax(axis=1)
            agree = (least[places] == np.frombuffer(sketches[q][8 * BANDS :], np.uint8)).sum(axis=1)
            if len(places := places[(agree >= AGREE) & (first == band[q])]):
                yield q, members[places]


def concerned(k: np.ndarray, block: np.ndarray, nodes: np.ndarray, fps: np.ndarray, roots: np.ndarray, asks: np.ndarray, band: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, ...]]:
    """k, block, node, root, asks, band of the members of a block that have a pair to be confirmed there."""
    seen = np.zeros(len(nodes), bool)
    for q, places in strangers(fps, roots, asks, band, sketches):
        seen[q] = seen[places] = True
    yield from zip(*(x[seen].tolist() for x in (k, block, nodes, roots, asks, band)), strict=True)


def joins(similarity: float) -> Callable[..., Iterator[tuple[int, int]]]:
    """For a block with its members' sets: pairs that strangers() gives and whose sets are so similar, as far as they join components of the block."""
    share = int(round(similarity * 1000))

    def find(nodes: np.ndarray, fps: np.ndarray, roots: np.ndarray, asks: np.ndarray, band: np.ndarray, sketches: np.ndarray, sets: np.ndarray) -> Iterator[tuple[int, int]]:
        up: dict[int, int] = {}

        def joined(r: int) -> int:
            while r in up:
                r = up[r]
            return r

        members = np.flatnonzero(asks == 0)
        if not len(members) or len(members) == len(nodes):
            return
        known, places = np.unique(np.concatenate(sets[members].tolist()), return_inverse=True)
        ends = np.cumsum([len(sets[i]) for i in members.tolist()])
        codes = dict(zip(members.tolist(), np.split(places.astype(np.int32), ends[:-1]), strict=True))
        marked = np.zeros(len(known), bool)
        for q, others in strangers(fps, roots, asks, band, sketches):
            at = np.minimum(np.searchsorted(known, sets[q]), len(known) - 1)
            at = at[known[at] == sets[q]]
            marked[at] = True
            for i in others.tolist():
                a, b = joined(int(roots[q])), joined(int(roots[i]))
                if a != b and (1000 + share) * int(np.count_nonzero(marked[codes[i]])) >= share * (len(sets[q]) + len(sets[i])):
                    up[a] = b
                    yield int(nodes[q]), int(nodes[i])
            marked[at] = False

    return find


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def first_pairs(left: DataFrame, sizes: DataFrame, fps: DataFrame) -> DataFrame:
    """Pass 1: links that chain the members of each bucket. left: node, k; sizes: k, n, least (its least node)."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = left.join(sizes, "k").join(fps, "node").select("k", F.pmod(F.xxhash64("node"), parts).cast("int").alias("block"), "node", "fp")
    several = sizes.filter(F.col("n") > BLOCK).withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
    shared = several.select("k", "block", F.col("least").alias("node")).join(fps, "node").select("k", "block", "node", "fp")
    dealt = rows.unionByName(shared).distinct().repartition("k", "block").sortWithinPartitions("k", "block")
    met = dealt.mapInArrow(lambda batches: block_rows(batches, 2, chains), "a long, b long")
    # a node is reached once a bucket; of its at most BANDS neighbours a few are confirmed, and pass 2 looks at what they leave apart
    reached = met.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("a", "b").alias("h"), "a"))), 1, FIRST).alias("x"))
    return ordered(reached.select("b", F.explode("x.a").alias("a")))


def other_links(left: DataFrame, roots: DataFrame, known: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pass 2: links of nodes of one bucket that no links join yet, confirmed in the bucket. known: node, fp, sketch; sets: node, shingles."""
    rest = left.join(roots, "node", "left").select("node", "k", "band", F.coalesce("root", "node").alias("root"))
    counts = rest.groupBy("k", "root").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("r"), F.max_by("root", F.struct("c", "root")).alias("major")).filter("r > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rest.join(mixed, "k").join(known.select("node", "fp", "sketch"), "node").withColumn("parts", parts)
    members = rows.select("k", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("block"), "node", "fp", "root", F.lit(0).alias("asks"), "band", "sketch")
    asking = rows.filter("root <> major").select("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), "node", "fp", "root", F.lit(1).alias("asks"), "band", "sketch")
    dealt = members.unionByName(asking).repartition("k", "block").sortWithinPartitions("k", "block")
    keyed = dealt.select("k", "block", F.col("k").alias("_k"), F.col("block").alias("_block"), "node", "fp", "root", "asks", "band", "sketch")
    names = "k block node root asks band"
    named = stored(keyed.mapInArrow(lambda batches: block_rows(batches, 2, concerned, names), ", ".join(f"{x} long" for x in names.split())), "concerned")

    # each side of a block is dealt in parts of ROOM, and every part of those that ask meets every part of the members
    size = F.col("size") + (8 + ROWS) * BANDS // 8
    parts = [F.ceil(F.sum(F.when(F.col("asks") == i, size)) / ROOM).cast("int").alias(f"parts{i}") for i in (0, 1)]
    room = named.join(sets.select("node", "size"), "node").groupBy("k", "block").agg(*parts)
    part = [F.when(F.col("asks") == i, F.array(F.pmod(F.xxhash64("node"), f"parts{i}").cast("int"))).otherwise(F.sequence(F.lit(0), F.col(f"parts{i}") - 1)) for i in (0, 1)]
    spread = named.join(room, ["k", "block"]).withColumn("x", F.explode(part[0])).withColumn("y", F.explode(part[1]))
    whole = spread.join(known.select("node", "fp", "sketch"), "node").join(sets.select("node", "shingles"), "node")
    met = whole.select("k", "block", "x", "y", "node", "fp", "root", "asks", "band", "sketch", "shingles").repartition("k", "block", "x", "y").sortWithinPartitions("k", "block", "x", "y")
    find = joins(similarity)
    return ordered(met.mapInArrow(lambda batches: block_rows(batches, 4, find), "a long, b long"))


def links(docs: DataFrame, found: DataFrame, similarity: float = 0.8) -> DataFrame:
    """found: prints of docs. Returns node, root of the nodes that links join, but for the roots."""
    listed = found.select("node", F.posexplode("bands").alias("band", "k")).distinct()
    sizes = listed.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    left = stored(listed.join(sizes.select("k"), "k"), "buckets")
    nodes = left.select("node").distinct()
    one = F.min(F.struct("row", "fp", "sketch")).alias("x")
    known = stored(found.join(nodes, "node").groupBy("node").agg(one).select("node", "x.*"), "nodes")
    fps, sets = known.select("node", "fp"), stored(shingle_sets(docs, known.select("node", "row")).withColumn("size", F.size("shingles")), "sets")
    sizes = left.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    first = stored(confirmed(first_pairs(left, sizes, fps), sets, similarity), "links")
    second = stored(other_links(left, components(first), known, sets, similarity), "links")
    roots = components(first.unionAll(second))
    for x in (left, sets, known):
        forget(x)
    return roots


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of linked texts: the least doc_id's (null last)."""
    found = stored(prints(docs), "prints")
    return one_of_each(docs, found.select("doc_id", "row", "node"), links(docs, found, similarity))
