"""Quality classifier: n-gram indicators scaled by Naive Bayes log-count ratios, then a linear SVM (operator 1).

Features of a text are indicators of n-grams over three alphabets: byte classes (case,
digit, each mark, other letter), word forms (first and last class, and whether the
word repeats one of the two before it) and the words themselves, folded (words that
few training texts hold count nothing). Every indicator is scaled by the log ratio of its
smoothed counts in both classes; a hinge-loss model is fitted to the scaled vectors by
dual coordinate descent; a sigmoid maps margins to scores, fitted as if both classes were equally frequent.

The model is fitted on at most TRAIN_ROWS labelled rows of each class (those with the least hash
of doc_id, one row of an id), never on held-out ones. Scoring reads every whole text in linear time, a pass of
PASS_BYTES at a time; features do not depend on where passes end.

Defined cases: null or empty text has no n-gram and gets the score of the bias alone;
null labels are no labels; a doc_id with several labels takes the least; without labels of
both classes the score is the share of label 1 (0.5 without labels); a null doc_id is held
out; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, slices

#: The most labelled rows of each class that a model is fitted on.
TRAIN_ROWS = 2000
BYTE_BITS, WORD_BITS, LEXICAL_BITS = 16, 16, 18
DIM = (1 << BYTE_BITS) + (1 << WORD_BITS) + (1 << LEXICAL_BITS)
#: Training texts that a word must stand in to count.
LEAST_TEXTS = 10
#: Bytes of a text that one numpy pass handles.
PASS_BYTES = 1 << 18


def byte_classes() -> np.ndarray:
    """Class of each byte: 1 lower, 2 upper, 3 digit, 4 letter beyond ASCII, 5 space, 6 line end, then a class for each mark."""
    table = np.zeros(256, np.uint32)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 1, 2, 3
    table[128:] = 4
    table[[9, 11, 12, 32]], table[[10, 13]] = 5, 6
    marks = [i for i in range(33, 127) if not table[i]]
    table[marks] = np.arange(7, 7 + len(marks))
    return table


CLASSES = byte_classes()


def hashed(columns: list[np.ndarray], salt: int, bits: int) -> np.ndarray:
    """One index for each row of symbols."""
    x = np.full(len(columns[0]), salt * 0x9E3779B1 & 0xFFFFFFFF, np.uint64)
    for c in columns:
        x = (x ^ c) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def ngram_indices(symbols: np.ndarray, longest: int, bits: int, salt: int) -> list[np.ndarray]:
    return [hashed([symbols[i : len(symbols) - n + 1 + i] for i in range(n)], salt + n, bits) for n in range(1, longest + 1) if len(symbols) >= n]


class Words:
    """Words between white space as they come pass by pass: a word that a pass cuts is put together again.

    feed() gives, for the words that have ended, their form (first and last class, second byte upper or not, and whether the word
    repeats one of the two before it) and a hash of their folded bytes.
    """

    def __init__(self):
        self.open: tuple | None = None  # first class, second byte upper, hash, bytes, last class of a word that has not ended
        self.before = np.zeros(0, np.uint64)  # hashes of the last two words

    def feed(self, raw: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = (classes == 5) | (classes == 6)
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
        runs = np.diff(np.append(starts, len(raw)))
        lead = int(starts[0]) if len(starts) else len(raw)
        place = np.arange(len(raw)) - np.concatenate([np.zeros(lead, np.int64), np.repeat(starts, runs)])
        joins = self.open is not None and lead == 0 and len(raw) > 0
        if joins:
            place[: runs[0]] += self.open[3]
        lower = np.where(classes == 2, raw + 32, raw).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (lower + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
            mixed ^= mixed >> np.uint64(29)
            mixed[blank] = 0
            words = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts) if len(starts) else np.zeros(0, np.uint64)
            first, last, second = classes[starts], classes[ends], classes[np.minimum(starts + 1, ends)] == 2
            if joins:
                f, s, h, n, _ = self.open
                words[0] += h
                first[0], second[0] = f, (classes[0] == 2) if n == 1 else s
            elif self.open is not None:
                f, s, h, _, e = self.open
                words, first, last, second = (np.concatenate([[x], y]).astype(y.dtype) for x, y in ((h, words), (f, first), (e, last), (s, second)))
        if len(ends) and ends[-1] == len(raw) - 1:
            n = int(ends[-1] - starts[-1]) + 1 + (self.open[3] if joins and len(starts) == 1 else 0)
            self.open = (first[-1], second[-1], words[-1], n, last[-1])
            words, first, last, second = words[:-1], first[:-1], last[:-1], second[:-1]
        elif len(raw):
            self.open = None
        return self.forms(words, first, last, second), words

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """What feed() gives for the last word."""
        if self.open is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        f, s, h, _, e = self.open
        words = np.array([h], np.uint64)
        return self.forms(words, np.array([f], np.uint32), np.array([e], np.uint32), np.array([s])), words

    def forms(self, words: np.ndarray, first: np.ndarray, last: np.ndarray, second: np.ndarray) -> np.ndarray:
        every = np.concatenate([self.before, words])
        again = np.zeros(len(every), np.uint64)
        again[1:] |= (every[1:] == every[:-1]).astype(np.uint64)
        again[2:] |= (every[2:] == every[:-2]).astype(np.uint64) << np.uint64(1)
        again = again[len(self.before) :]
        self.before = every[-2:]
        return (first | last << np.uint32(6) | second.astype(np.uint32) << np.uint32(12)).astype(np.uint64) | again << np.uint64(13)


#: Longest n-grams of bytes, word forms and words.
BYTE_GRAMS, FORM_GRAMS, WORD_GRAMS = 3, 4, 1


def features(text: str) -> np.ndarray:
    """Distinct feature indices of a whole text, wherever passes cut it: what an n-gram needs of the pass before is carried over."""
    raw, seen, stream = np.frombuffer(text.encode("utf-8", "replace"), np.uint8), None, Words()
    tails = [np.zeros(0, np.uint64)] * 3
    for at in range(0, max(len(raw), 1), PASS_BYTES):
        part = raw[at : at + PASS_BYTES]
        classes = CLASSES[part]
        forms, words = stream.feed(part, classes)
        if at + PASS_BYTES >= len(raw):
            forms, words = (np.concatenate(x) for x in zip((forms, words), stream.close(), strict=True))
        found, first = [], 0
        for i, (new, longest, bits, salt) in enumerate(((classes.astype(np.uint64), BYTE_GRAMS, BYTE_BITS, 1), (forms, FORM_GRAMS, WORD_BITS, 11), (words, WORD_GRAMS, LEXICAL_BITS, 21))):
            symbols = np.concatenate([tails[i], new]) if len(tails[i]) else new
            found += [x + first for x in ngram_indices(symbols, longest, bits, salt)]
            tails[i], first = symbols[len(symbols) - min(longest - 1, len(symbols)) :], first + (1 << bits)
        got = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
        seen = got if seen is None else distinct(np.concatenate([seen, got]))
    return seen


_STAMP = np.zeros(DIM, np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Each value once, without a sort: the last position that wrote a value keeps it."""
    at = np.arange(len(x))
    _STAMP[x] = at
    return x[_STAMP[x] == at]


class Model:
    """weights: on raw indicators, log-count ratios included; a text's margin is their sum over its features, divided by the norm of its scaled vector."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float, share: float | None = None):
        self.squares, self.weights, self.bias, self.slope, self.offset, self.share = (ratios**2).astype(np.float32), (weights * ratios).astype(np.float32), bias, slope, offset, share

    def margin(self, f: np.ndarray) -> float:
        norm = float(self.squares[f].sum(dtype=np.float64)) ** 0.5 or 1.0
        return float(self.weights[f].sum(dtype=np.float64)) / norm + self.bias

    def score(self, text: str) -> float:
        if self.share is not None:
            return self.share
        z = max(-500.0, min(500.0, self.slope * self.margin(features(text)) + self.offset))
        return float(1 / (1 + np.exp(-z)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(DIM, alpha) for _ in range(2)]
    for f, y in zip(rows, labels, strict=True):
        counts[int(y > 0)][f] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rare = counts[0] + counts[1] - 2 * alpha < LEAST_TEXTS
    rare[: DIM - (1 << LEXICAL_BITS)] = False
    ratios[rare] = 0
    return ratios


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, rounds: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost * hinge, one dual variable at a time."""
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(rows))
    squares = np.array([float(v @ v) + 1.0 for v in values])
    order, draw = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        draw.shuffle(order)
        worst = 0.0
        for i in order:
            f, v, y = rows[i], values[i], labels[i]
            gradient = y * (float(w[f] @ v) + bias) - 1
            if (alpha[i] <= 0 and gradient >= 0) or (alpha[i] >= cost[i] and gradient <= 0):
                continue
            worst = max(worst, abs(gradient))
            new = min(max(alpha[i] - gradient / squares[i], 0.0), cost[i])
            step, alpha[i] = (new - alpha[i]) * y, new
            w[f] += step * v
            bias += step
        if worst < 1e-3:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, with smoothed targets (Newton steps). Both classes count alike, however many rows each has."""
    n1 = float((labels > 0).sum())
    n0 = len(labels) - n1
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels > 0, len(labels) / 2 / n1, len(labels) / 2 / n0)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margins, g.sum()])
        hess = np.array([[h @ margins**2 + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(rows: list[np.ndarray], labels: list[int], cost: float = 1.0) -> Model:
    """A model of labelled feature sets (labels 0 or 1)."""
    y = np.where(np.array(labels, np.int64) > 0, 1.0, -1.0) if len(labels) else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(DIM), np.zeros(DIM), 0, 0, 0, share=float((y > 0).mean()) if len(y) else 0.5)
    ratios = log_count_ratios(rows, y)
    values = [((v := ratios[f]) / (float(v @ v) ** 0.5 or 1.0)).astype(np.float32) for f in rows]
    weight = np.where(y > 0, len(y) / 2 / (y > 0).sum(), len(y) / 2 / (y < 0).sum()) * cost
    w, bias = dual_coordinate_descent(rows, values, y, weight)
    margins = np.array([float(w[f] @ v) + bias for f, v in zip(rows, values, strict=True)])
    return Model(ratios, w, bias, *sigmoid_fit(margins, y))


def remainder(id_col: str, mod: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def training_ids(labels: DataFrame, target: str, learn: F.Column, limits: tuple[int, int]) -> DataFrame:
    """doc_id and label y of the rows to learn from: at most limits[y] of each class, by the least hash."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).filter(learn).groupBy("doc_id").agg(F.min("y").alias("y"))
    part = lambda y: rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits[y])
    return part(0).unionAll(part(1))


def training_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, y, text of the ids that documents hold, one row of an id (the least text), so that as many texts as ids are fetched."""
    found = keyed_texts(docs).join(F.broadcast(ids), "doc_id")  # ids are bounded by the limits of the fit
    return found.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", mod: int = 5, held_out: int = 0, limit: int = TRAIN_ROWS) -> Model:
    """Learns from the labelled documents whose crc32(doc_id) mod `mod` is not held_out; at most limit of each class."""
    ids = training_ids(labels, target, remainder("doc_id", mod) != held_out, (limit, limit))
    texts = training_texts(docs, ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                found = [features(t).astype(np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "f"])

    got = texts.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, f array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return train([], [])
    lists = got.column("f").chunk(0)
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return train([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], got.column("y").to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(t) for t in part.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs whose text scores at least threshold, all columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                texts = part.column(at).to_pylist()
                yield part.filter(pa.array([model.score(t or "") >= threshold for t in texts], pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
