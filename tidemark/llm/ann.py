"""Approximate nearest neighbours by inner product over balanced posting lists (operator 6).

Largest inner product becomes smallest distance by one more component that lifts every vector to
the greatest norm. Centroids come from balanced k-means on a sample; there are as many as the square root of the number of rows,
up to MOST_LISTS (or CENTROID_BYTES), and the sample holds up to PER_LIST vectors for each. A vector is listed under its nearest centroid and, near a boundary, under up to COPIES in all.
A query walks a neighbour graph of the centroids, best first, and takes every list whose distance is
within a ratio of the nearest; the ratio is the least that reaches TARGET recall among sample queries.
Where those lists are too small it goes on to farther ones: COPIES * (k + 1) listed ids are at least k + 1 different ones.
Lists meet their queries by a shuffle on shelves: neighbouring lists stand on one shelf, which holds at most SHELF vectors, and a
longer list is dealt to several shelves of its own; a query goes once to each shelf that holds lists of its choice. So no task
holds a whole hot list. Every row is indexed. Scores are inner products in double precision of the vectors
as given.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; of vectors of different lengths
the shorter one has zeros behind its end; a query never finds rows of its own id (repeated rows included); of several query rows of
one id the least vector asks; a candidate id with several vectors counts once, with the best; ties go to the smaller vec_id; with
fewer candidates than k all of them are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The most lists; bytes of their centroids; vectors of the sample for each.
MOST_LISTS, CENTROID_BYTES, PER_LIST = 16_384, 64 << 20, 100
#: Bytes of the sample; lists that may hold one vector; how much farther (squared) the others may be.
SAMPLE_BYTES, COPIES, BOUNDARY = 64 << 20, 2, 1.03
#: Distances that are held at once; clusters beyond which k-means runs in two levels.
AT_ONCE, FLAT = 1 << 22, 600
#: Vectors of one shelf; recall in the sample that the ratio is chosen for; sample queries it is chosen with; links of a centroid in the graph.
SHELF, TARGET, PROBES, LINKS = 8192, 0.96, 300, 16


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of float or double) of the vectors that take part."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = vectors.schema[vector_col].dataType.simpleString()
    wide = v if kind in ("array<float>", "array<double>") else v.cast("array<double>")  # floats become doubles where they are multiplied
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("vec_id"), wide.alias("v"))
    return rows


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a column of lists in double precision, each with zeros up to `size`."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) == len(column) * size and (not len(column) or pc.min_max(pc.list_value_length(column))["min"].as_py() == size):
        return flat.reshape(len(column), size)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), size))
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def stretches(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows whose product with width is at most AT_ONCE."""
    step = max(1, AT_ONCE // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


class Lists:
    """Centroids, their neighbour graph and the pruning ratio."""

    def __init__(self, sample: np.ndarray, top: float, n: int, seed: int = 5):
        self.top, self.size = top, sample.shape[1]
        x = self.lifted(sample)
        n = max(1, min(len(x), n))
        self.centroids = balanced_means(x, n, seed)
        self.squares = (self.centroids**2).sum(1)
        links = [set() for _ in range(n)]
        for part in stretches(n, n):
            d = self.distances(self.centroids[part])
            m = min(LINKS + 1, n)
            for i, r in enumerate(np.argpartition(d, m - 1, axis=1)[:, :m], part.start):  # both ways, and a ring that keeps the graph connected
                for j in [*r.tolist(), (i + 1) % n]:
                    links[j].add(i)
                    links[i].add(j)
        self.links = [np.array(sorted(r - {i}), np.int64) for i, r in enumerate(links)]
        self.start = int(self.distances(self.centroids.mean(0, keepdims=True)).argmin())
        self.ratio = 1.0
        self.ratio = self.tuned(sample)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (x**2).sum(1), 0))
        return np.column_stack([x, rest])

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.centroids.T + self.squares, 1e-12)

    def shelves(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each list's first shelf and number of shelves: lists near each other share one while it has room, a long list has several of its own."""
        n = len(self.squares)
        coarse = balanced_means(self.centroids, max(1, math.isqrt(n)), 7)
        order = np.argsort(nearest_of(self.centroids, coarse, np.zeros(len(coarse))), kind="stable")
        first, parts, shelf, used = np.zeros(n, np.int64), np.ones(n, np.int64), 0, 0
        for j in order:
            if used and used + entries[j] > SHELF:
                shelf, used = shelf + 1, 0
            first[j], parts[j] = shelf, max(1, -(-entries[j] // SHELF))
            used += entries[j]
            if parts[j] > 1:
                shelf, used = shelf + parts[j], 0
        return first, parts

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs under which the vectors are listed."""
        rows, lists = [], []
        for part in stretches(len(x), len(self.squares)):
            d = self.distances(self.lifted(x[part]))
            m = min(COPIES, d.shape[1])
            at = np.argpartition(d, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(d, at, axis=1)
            row, k = np.nonzero(near <= near.min(1, keepdims=True) * BOUNDARY)
            rows.append(row + part.start)
            lists.append(at[row, k])
        return np.concatenate(rows), np.concatenate(lists)

    def chosen(self, q: np.ndarray, held: np.ndarray, need: int) -> list[int]:
        """Lists for one query: best-first over the graph, to the pruning ratio, and on until they hold need entries (held: entries of each list) or no list is left."""
        q = np.append(q, 0.0)
        square = float(q @ q)

        def distance(ids: np.ndarray) -> np.ndarray:
            return np.maximum(square - 2 * self.centroids[ids] @ q + self.squares[ids], 1e-12)

        first = float(distance(np.array([self.start]))[0])
        seen = np.zeros(len(self.squares), bool)
        seen[self.start] = True
        heap, found, best, total = [(first, self.start)], [], first, 0
        while heap:
            d, i = heapq.heappop(heap)
            if d > best * self.ratio and len(found) >= LINKS and total >= need:
                break
            found.append((d, i))
            total += int(held[i])
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for dist, j in zip(distance(new).tolist(), new.tolist(), strict=True):
                best = min(best, dist)
                heapq.heappush(heap, (dist, j))
        out, total = [], 0
        for d, i in sorted(found):
            if d > best * self.ratio and total >= need:
                break
            out.append(i)
            total += int(held[i])
        return out

    def tuned(self, sample: np.ndarray, k: int = 20) -> float:
        """The least ratio at which sample queries find TARGET of their nearest in the sample."""
        step = max(1, len(sample) // PROBES)
        q = sample[::step]
        k = min(k, len(sample) - 1)
        if k < 1 or len(self.squares) == 1:
            return 1.0
        best = np.empty((len(q), k), np.int64)
        for part in stretches(len(q), len(sample)):
            scores = q[part] @ sample.T
            scores[np.arange(len(scores)), (np.arange(len(scores)) + part.start) * step] = -np.inf
            best[part] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        near, where = np.unique(best, return_inverse=True)
        where = where.reshape(best.shape)
        row, place = self.places(sample[near])
        starts = np.searchsorted(row, np.arange(len(near) + 1))
        d = self.distances(np.column_stack([q, np.zeros(len(q))]))
        d /= d.min(1, keepdims=True)
        # a neighbour is found once the nearest of its lists is within the ratio
        needed = [d[i, place[starts[j] : starts[j + 1]]].min() for i, js in enumerate(where) for j in js]
        return float(np.quantile(needed, TARGET)) * (1 + 1e-9)


def balanced_means(x: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means whose assignment pays for the size that a cluster already has; many clusters are made inside fewer ones."""
    if n > FLAT:
        coarse = balanced_means(x, round(n**0.5), seed, rounds)
        at = nearest_of(x, coarse, np.zeros(len(coarse)))
        size = np.bincount(at, minlength=len(coarse))
        quota = np.minimum(np.maximum(np.floor(size * n / len(x)), size > 0), size).astype(np.int64)
        for i in np.argsort(quota - size * n / len(x), kind="stable"):  # what rounding left over
            if quota.sum() < n and quota[i] < size[i]:
                quota[i] += 1
        return np.concatenate([balanced_means(x[at == i], int(m), seed + 1 + i, rounds) for i, m in enumerate(quota) if m])
    draw = np.random.default_rng(seed)
    c = x[np.sort(draw.choice(len(x), n, replace=False))].copy()
    share, load = len(x) / n, np.zeros(n)
    for _ in range(rounds):
        at = nearest_of(x, c, load)
        size = np.bincount(at, minlength=n)
        load = 0.5 * load + 0.5 * (size / share - 1)
        order = np.argsort(at, kind="stable")
        some = np.flatnonzero(size)
        total = np.add.reduceat(x[order], (np.cumsum(size) - size)[some], axis=0)
        c[some] = total / size[some, None]
    return c


def nearest_of(x: np.ndarray, c: np.ndarray, load: np.ndarray) -> np.ndarray:
    """The centroid of each row, at a price for those that are loaded."""
    out = np.empty(len(x), np.int64)
    for part in stretches(len(x), len(c)):
        d = (c**2).sum(1) - 2 * x[part] @ c.T
        spread = float(np.abs(d - d.mean(1, keepdims=True)).mean()) or 1.0
        out[part] = (d + 0.2 * spread * load).argmin(1)
    return out


def fit(rows: DataFrame) -> Lists | None:
    """rows: vec_id, v. None if there are no vectors."""
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    top, size, count = rows.agg(F.max(norm), F.max(F.size("v")), F.count("*")).first()
    if top is None:
        return None
    lists = max(1, min(math.isqrt(count), MOST_LISTS, CENTROID_BYTES // (8 * (size + 1))))
    most = max(1, min(lists * PER_LIST, SAMPLE_BYTES // (8 * size)))
    spread = 1 << 30
    share = min(spread, int(1.1 * spread * (most + 1000) / count) + 1)  # so that few more rows than the sample are sorted
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(spread)) < share)
    sample = some.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).select("vec_id", "v").toArrow().sort_by("vec_id")
    return Lists(matrix(sample.column("v").combine_chunks(), size), float(top), lists)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of each query row found in vectors: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    if not rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["vec_id", "v"])
    lists = fit(rows)
    if lists is None:
        return spark.range(0).selectExpr("id AS query_id", "cast(id AS int) AS rank", "id AS vec_id", "cast(id AS double) AS score")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, at = lists.places(matrix(batch.column(1), lists.size))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["list", "id", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    posted = stored(rows.mapInArrow(place, f"list int, id long, v {kind}"), "postings")
    counted = posted.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect()  # a row for each of at most MOST_LISTS lists
    held, entries = np.zeros(len(lists.squares), np.int64), np.zeros(len(lists.squares), np.int64)
    for r in counted:
        held[r.list], entries[r.list] = r.ids, r.n
    first, parts = lists.shelves(entries)
    shelved = F.broadcast(spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first, parts, strict=True))], "list int, first int, parts int"))  # at most MOST_LISTS rows

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shelf, row, wanted = [], [], []
            for i, q in enumerate(matrix(batch.column(1), lists.size)):
                by_shelf: dict[int, list[int]] = {}
                for j in lists.chosen(q, held, COPIES * (k + 1)):
                    for at in range(first[j], first[j] + parts[j]):
                        by_shelf.setdefault(int(at), []).append(j)
                shelf += by_shelf
                row += [i] * len(by_shelf)
                wanted += by_shelf.values()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shelf, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(wanted, pa.list_(pa.int32()))], names=["shelf", "id", "v", "lists"])

    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.slice(F.min("v"), 1, lists.size).alias("v"))
    chosen = asked.mapInArrow(choose, f"shelf int, id long, v {asked.schema['v'].dataType.simpleString()}, lists array<int>")
    at = (F.col("first") + F.pmod(F.xxhash64("id", "v"), "parts")).cast("int")
    left = posted.join(shelved, "list").select(at.alias("shelf"), F.lit(0).alias("kind"), "id", "v", F.array("list").alias("lists"))
    right = chosen.select("shelf", F.lit(1).alias("kind"), "id", F.col("v").cast(kind).alias("v"), "lists")
    met = left.unionAll(right).repartition("shelf").sortWithinPartitions("shelf", "kind", F.when(F.col("kind") == 0, F.col("lists")[0]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each shelf the k best of every query that chose lists on it."""
        key, parts_of = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            shelf, kinds, ids = (batch.column(i).to_numpy() for i in range(3))
            x, wanted = matrix(batch.column(3), lists.size), batch.column(4)
            cuts = np.flatnonzero((shelf[1:] != shelf[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shelf)], strict=True):
                if shelf[a] != key:
                    key, parts_of, filled = shelf[a], [], None
                if kinds[a] == 0:
                    parts_of.append((ids[a:b], x[a:b], wanted.slice(a, b - a).flatten().to_numpy()))
                elif parts_of:
                    filled = filled or Shelf(*(np.concatenate(c) for c in zip(*parts_of, strict=True)))
                    for at in range(a, b, 256):
                        end = min(b, at + 256)
                        out += filled.nearest(ids[at:end], x[at:end], wanted.slice(at, end - at).to_pylist(), k)
            ends = np.cumsum([0] + [len(r[1]) for r in out]).astype(np.int32)
            flat = lambda c, t: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[c] for r in out]) if out else np.zeros(0), t))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), flat(1, pa.int64()), flat(2, pa.float64())], names=["query_id", "ids", "scores"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each query's lists, which follow each other, the k best."""
        last, ids, scores = None, [], []
        for batch in batches:
            out = []
            for q, i, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if q != last:
                    if ids:
                        out.append((last, *best(ids, scores, k)))
                    last, ids, scores = q, [], []
                ids.append(i.values.to_numpy())
                scores.append(s.values.to_numpy())
            yield ranked(out)
        if ids:
            yield ranked([(last, *best(ids, scores, k))])

    found = met.mapInArrow(scan, "query_id long, ids array<long>, scores array<double>")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def best(ids: list[np.ndarray], scores: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of several lists, each id once with its best score, ties to the smaller id."""
    i, s = np.concatenate(ids), np.concatenate(scores)
    order = np.lexsort((-s, i))
    i, s = i[order], s[order]
    first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
    i, s = i[first], s[first]
    order = np.lexsort((i, -s))[:k]
    return i[order], s[order]


def ranked(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    empty = np.zeros(0)
    sizes = [len(i) for _, i, _ in rows]
    columns = [np.repeat([q for q, _, _ in rows], sizes) if rows else empty, np.concatenate([np.arange(1, n + 1) for n in sizes]) if rows else empty, np.concatenate([i for _, i, _ in rows]) if rows else empty, np.concatenate([s for _, _, s in rows]) if rows else empty]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])


class Shelf:
    """The vectors of some lists, ordered by list."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, lists: np.ndarray):
        self.ids, self.block = ids, block
        self.repeats = len(np.unique(ids)) < len(ids)  # an id with several vectors, or in several lists
        names, starts = np.unique(lists, return_index=True)
        self.slices = {int(j): slice(int(a), int(b)) for j, a, b in zip(names, starts, [*starts[1:], len(lists)], strict=True)}

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, wanted: list[list[int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the k best of the lists it wants: (query_id, ids, scores), ties to the smaller id."""
        by_list: dict[int, list[int]] = {}
        for i, lists in enumerate(wanted):
            for j in lists:
                by_list.setdefault(j, []).append(i)
        scores = np.full((len(queries), len(self.ids)), -np.inf)
        for j, rows in by_list.items():
            if j in self.slices:
                scores[np.array(rows), self.slices[j]] = queries[rows] @ self.block[self.slices[j]].T
        wide = k * (COPIES + 1) if self.repeats else k
        for q, x, s in zip(query_ids.tolist(), queries, scores, strict=True):
            s[self.ids == q] = -np.inf
            some = np.flatnonzero(s > -np.inf)
            if len(some) > wide:
                least = np.partition(s[some], len(some) - wide)[len(some) - wide]
                near = some[s[some] >= least - 1e-9 * (1 + abs(least))]
                if not self.repeats or len(np.unique(self.ids[near])) >= k:
                    some = near
            exact = (self.block[some] * x).sum(axis=1)  # the same sum for the same pair wherever it stands
            yield q, *best([self.ids[some]], [exact], k)
