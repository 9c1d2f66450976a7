"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text (operator 9).

Folding lower-cases, applies compatibility forms, drops invisible characters, maps look-alike
letters of other scripts and digits or marks that stand for letters to one Latin letter
each. The lexicon holds whole words and stems (word beginnings); it is learned from labelled
documents: an entry is taken if it stands in toxic documents far more often than chance allows, and if it
explains some that the entries before it do not (greedy cover). Its weight is its rarity: the negative log of
its rate in clean documents. Hits inside an exception phrase do not count.

The score is normalised by length: an entry that occurs c times (as different words) among L words adds
c * (weight + log(c / L) - 1), the log-likelihood of that count against clean text of the same
length, if that is positive. So one rare word marks a document of any usual length, while a stem that clean
text begins by chance needs several words, the more the longer the text. The sum maps to 0..1.

Learning uses at most TOXIC_ROWS and CLEAN_ROWS labelled rows (those with the least hash of doc_id, one row of an id),
never held-out ones. Scoring reads every whole text.

Defined cases: null or empty text scores 0; null labels are no labels; a doc_id with several
labels takes the least, one with several texts is learned from the least text; without toxic labels the lexicon is empty and every score is 0;
repeated rows are scored each; a null doc_id is never learned from.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import keyed_texts, slices
from .nbsvm import remainder, training_ids, training_texts

TOXIC_ROWS, CLEAN_ROWS = 1500, 4000
#: Lengths of stems in letters; different words that a stem must begin; toxic documents that an entry must stand in.
STEMS, COMPLETIONS, LEAST = (3, 4, 5, 6), 4, 3
#: How many times likelier an entry must be in toxic documents; for words beside the cover.
RATIO, SURE_RATIO = 4.0, 20.0
#: Log-likelihood that explains a document; what an entry must explain in all; the sum that maps to 0.7; words of the shortest text.
ENOUGH, GAIN, MARK, SHORT = 6.0, 12.0, 7.0, 20
#: What the count of an entry that clean documents lack is taken for.
UNSEEN = 0.1

#: Look-alike letters of other scripts. Fixed values.
LOOKALIKES = dict(zip("абвгдеёзіїјкмнопрстухѕԁɡαβεικνορτυχω", "abbrdee3iijkmhonpctyxsdgabeiknopryxw", strict=True))
#: Digits and marks that stand for letters; l and i fold together because 1 stands for both. Fixed values.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
INNER_MARKS = {"@": "a", "$": "s", "!": "i", "|": "i", "*": ""}
#: Invisible characters. Fixed values.
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which an entry is harmless. Fixed values, a parameter of the scorer.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash day", "clown fish", "clown nose", "circus clown", "pathetic fallacy", "sore loser rule", "scum line", "pond scum")

TABLE = str.maketrans({**{k: STAND_INS.get(v, v) for k, v in LOOKALIKES.items()}, **STAND_INS, **{c: None for c in INVISIBLE}})
MARK_TABLE = str.maketrans(INNER_MARKS)
MARKED = regex.compile(r"(?<=\w)[@$!|*]+(?=\w)")
WORD = regex.compile(r"\w+")


def fold(text: str) -> str:
    """The text as the lexicon sees it."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "@" in text or "$" in text or "!" in text or "|" in text or "*" in text:
        text = MARKED.sub(lambda m: m[0].translate(MARK_TABLE), text)
    return text.translate(TABLE)


class Scorer:
    """entries: folded words, stems with a trailing *, and their weights."""

    def __init__(self, entries: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS):
        self.entries = entries
        self.machine = ahocorasick.Automaton()
        kinds: dict[str, list] = defaultdict(list)
        for e, w in entries.items():
            kinds[e.rstrip("*")].append((e, e[-1:] == "*", w))
        for x in exceptions:
            kinds[fold(x)].append((x, False, None))
        for k, v in kinds.items():
            self.machine.add_word(k, (len(k), v))
        self.ready = bool(kinds)
        if self.ready:
            self.machine.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, entry) of each counted entry in the folded text; end is that of the entry, not of its word."""
        return self.hits_in(fold(text))

    def hits_in(self, text: str) -> list[tuple[int, int, str]]:
        found: dict[int, tuple[float, int, str]] = {}
        safe: list[tuple[int, int]] = []
        if not self.ready:
            return []
        n = len(text)
        for last, (size, kinds) in self.machine.iter(text):
            start, end = last + 1 - size, last + 1
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            inside = end < n and (text[end].isalnum() or text[end] == "_")
            for entry, stem, weight in kinds:
                if stem != inside:
                    continue
                if weight is None:
                    safe.append((start, end))
                else:  # one hit for each word: its heaviest entry
                    found[start] = max(found.get(start, (0.0, 0, "")), (weight, end, entry))
        spans = Spans(safe)
        return [(a, b, e) for a, (_, b, e) in sorted(found.items()) if not spans.hold(a)]

    def score(self, text: str) -> float:
        text = fold(text)
        hits = self.hits_in(text)
        if not hits:
            return 0.0
        words: dict[str, set[str]] = defaultdict(set)
        for a, b, e in hits:
            words[e].add(text[a : WORD.match(text, a).end()])
        length = max(SHORT, text.count(" ") + text.count("\n") + 1)
        total = sum(likelihood(self.entries[e], len(w), length) for e, w in words.items())
        return 1 - math.exp(total * math.log(0.3) / MARK)


class Spans:
    """Membership in spans that come in order of their ends, in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def hold(self, at: int) -> bool:
        i = bisect_right(self.starts, at) - 1
        return i >= 0 and at < self.ends[i]


def likelihood(weight: float, count: int, length: int) -> float:
    """How much likelier a count is where the entry is at home than in clean text of this length; 0 at least."""
    return max(0.0, count * (weight + math.log(count / length) - 1))


def entries_of(words: Iterable[str]) -> set[str]:
    """Whole words and stems that a set of folded words contains."""
    out = set()
    for w in words:
        if len(w) > 2 and not w[0].isdigit():
            out.add(w)
            out.update(w[:n] + "*" for n in STEMS if len(w) > n)
    return out


def unlike(docs: list[dict[str, int]]) -> list[dict[str, int]]:
    """One of each group of copies: documents whose two least hashed words of six letters or more are the same."""
    out = {}
    for i, x in enumerate(docs):
        least = sorted(zlib.crc32(w.encode()) for w in x if len(w) > 5)[:2]
        out.setdefault(tuple(least) if len(least) == 2 else i, x)
    return list(out.values())


def chance(hits: int, total: int, share: float) -> float:
    """An upper bound (Chernoff's) of the probability that at least `hits` of `total` fall on a class of this share."""
    rate = hits / total
    if rate <= share:
        return 1.0
    far = rate * math.log(rate / share) + ((1 - rate) * math.log((1 - rate) / (1 - share)) if rate < 1 else 0.0)
    return math.exp(-total * far)


def learn(toxic: list[dict[str, int]], clean: list[dict[str, int]]) -> dict[str, float]:
    """Entries and weights from the folded words (with their counts) of toxic and of clean documents."""
    toxic = unlike(toxic)
    sets = [entries_of(x) for x in toxic]
    counts = Counter(e for x in sets for e in x)
    where: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(sets):
        for e in x:
            if counts[e] >= LEAST:
                where[e].append(i)
    del sets, counts
    forms: dict[str, set[str]] = defaultdict(set)  # a stem needs several words that begin with it
    for x in toxic:
        for w in x:
            for n in STEMS:
                if len(w) > n and (e := w[:n] + "*") in where and len(forms[e]) < COMPLETIONS:
                    forms[e].add(w)
    where = {e: v for e, v in where.items() if e[-1] != "*" or len(forms[e]) >= COMPLETIONS}
    if not where:
        return {}
    others, rates, size = Counter(), Counter(), 1
    for x in clean:
        size += sum(x.values())
        words: dict[str, int] = defaultdict(int)  # different words, as scoring counts them
        for w in x:
            for e in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)):
                if e in where:
                    words[e] += 1
        others.update(words.keys())
        rates.update(words)
    lengths = [max(SHORT, sum(x.values())) for x in toxic]
    share, most = (len(toxic) + 1) / (len(toxic) + len(clean) + 2), 0.3 / len(where)
    total = sum(lengths)
    expected = {e: min(len(toxic), (rates[e] + UNSEEN) / size * total) for e in where}
    weights = {e: -math.log((rates[e] + UNSEEN) / size) for e in where}
    sure = lambda e, v: len(v) >= max(LEAST, RATIO * expected[e]) and chance(len(v), len(v) + others[e], share) <= most
    kept = {e: v for e, v in where.items() if sure(e, v)}
    worth = {e: {i: min(ENOUGH, likelihood(weights[e], occurrences(e, toxic[i]), lengths[i])) for i in v} for e, v in kept.items()}
    lexicon = {e: weights[e] for e in cover(worth, len(toxic))}
    # words that the cover made superfluous still mark documents that hold nothing else
    for e in sorted(kept):
        if e[-1] != "*" and not known(e, lexicon) and len(kept[e]) >= SURE_RATIO * (others[e] + UNSEEN) * len(toxic) / (len(clean) + 1):
            lexicon[e] = weights[e]
    return lexicon


def known(word: str, lexicon: dict[str, float]) -> bool:
    return word in lexicon or any(word[:n] + "*" in lexicon for n in STEMS if len(word) > n)


def occurrences(entry: str, words: Iterable[str]) -> int:
    """How many different words an entry hits."""
    if entry[-1] != "*":
        return int(entry in words)
    return sum(w.startswith(entry[:-1]) and len(w) >= len(entry) for w in words)


def cover(worth: dict[str, dict[int, float]], n: int) -> list[str]:
    """Entries, the most explaining first, until no other explains GAIN more of what documents need (ENOUGH each)."""
    by_doc: dict[int, list[str]] = defaultdict(list)
    for e, x in worth.items():
        for i in x:
            by_doc[i].append(e)
    need, out = [ENOUGH] * n, []
    gain = {e: sum(x.values()) for e, x in worth.items()}
    while gain:
        best = max(gain, key=lambda e: (round(gain[e], 6), len(e), e))
        if gain.pop(best) < GAIN:
            break
        out.append(best)
        for i, x in worth[best].items():
            before, need[i] = need[i], max(0.0, need[i] - x)
            for e in by_doc[i]:
                if e in gain and need[i] < before:
                    gain[e] += min(need[i], worth[e][i]) - min(before, worth[e][i])
    return out


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", mod: int = 3, held_out: int = 1) -> dict[str, float]:
    """Learns the lexicon from documents whose crc32(doc_id) mod `mod` is not held_out."""
    ids = training_ids(labels, target, remainder("doc_id", mod) != held_out, (CLEAN_ROWS, TOXIC_ROWS))
    texts = training_texts(docs, ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                found = [Counter(WORD.findall(fold(t))) for t in part.column(1).to_pylist()]
                lists = [pa.array([list(x.keys()) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], names=["doc_id", "y", "words", "counts"])

    got = texts.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, words array<string>, counts array<int>").toArrow().sort_by("doc_id")
    rows = [(y, dict(zip(w.as_py(), n.as_py(), strict=True))) for y, w, n in zip(got.column("y").to_pylist(), got.column("words"), got.column("counts"), strict=True)]
    return learn([x for y, x in rows if y], [x for y, x in rows if not y])


def score(docs: DataFrame, entries: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(entries, exceptions)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([scorer.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
