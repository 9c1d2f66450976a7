"""BPE encoding and decoding with a word-end vocabulary (operator 10).

Method: each word's symbols form a doubly linked list; a heap holds the merge
rank of every adjacent pair; the lowest rank (leftmost on ties) merges first, and
entries whose pair has changed since are stale and skipped. Decoding joins the
vocabulary strings of the ids with one space, as a tokenizer without a decoder does.

Defined cases: null or empty text gives no ids and empty text; strings of the
special tokens become their ids; words of any length are merged in
O(n log n); repeated rows give repeated results; a null doc_id is kept.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable
from hashlib import sha256
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .common import keyed_texts, per_text

#: White space as the vocabulary's pattern understands it (Unicode White_Space). Fixed values.
WHITE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Separators that str.split() knows beyond White_Space. Fixed values.
EXTRA_SPLIT = regex.compile("[\x1c-\x1f]")
#: The vocabulary's pre-tokenizer pattern. Fixed value.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
#: Cached chunks and words of one worker; a longer one is never cached.
CACHED, CACHED_CHARS = 250_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file whose last symbol of a word carries a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for s, i in chain(vocab.items(), added.items()):
            self.strings[i] = s
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + end] for x in letters]
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = added
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.marks = [x[:2] for x in added]
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word by a heap over a linked list."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        heap = [(*found, i) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or ranks.get((ids[i], ids[j])) != (rank, new):
                continue  # stale
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return tuple(x for x in ids if x >= 0)

    def word(self, word: str) -> tuple[int, ...]:
        got = self.words.get(word)
        if got is None:
            got = self.merge(word)
            if len(word) <= CACHED_CHARS:
                if len(self.words) >= CACHED:
                    self.words.clear()
                self.words[word] = got
        return got

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of what stands between two white spaces."""
        if chunk.isalpha():
            return self.word(chunk)
        got = tuple(chain.from_iterable(map(self.word, WORDS.findall(chunk))))
        return got

    def segment(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        if EXTRA_SPLIT.search(text):
            return [i for w in WORDS.findall(text) for i in self.word(w)]
        chunks, known = text.split(), self.chunks
        try:
            return list(chain.from_iterable(map(known.__getitem__, chunks)))
        except KeyError:
            pass
        if len(known) >= CACHED:
            known.clear()
        out: list[int] = []
        for c in chunks:
            got = known.get(c)
            if got is None:
                got = self.chunk(c)
                if len(c) <= CACHED_CHARS:
                    known[c] = got
            out += got
        return out

    def encode(self, text: str) -> list[int]:
        if not self.splitter or not any(x in text for x in self.marks):
            return self.segment(text)
        out: list[int] = []
        for part in self.splitter.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.segment(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """The file's codec, loaded once a worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def as_ids_and_text(bpe: WordBpe, doc_id: int, ids: list[int]) -> dict:
    return {"doc_id": doc_id, "n_tokens": len(ids), "ids": ids, "decoded": bpe.decode(ids)}


def as_digests(bpe: WordBpe, doc_id: int, ids: list[int]) -> dict:
    """Digests of the ids in decimal and of the decoded text, without moving either to the JVM."""
    number = map(str, ids)
    return {"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": sha256(" ".join(number).encode()).hexdigest(), "decoded_sha256": sha256(bpe.decode(ids).encode("utf-8")).hexdigest()}


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", finish: Callable = as_ids_and_text, schema: str = "doc_id long, n_tokens long, ids array<int>, decoded string") -> DataFrame:
    """Encodes and decodes every text. finish makes the output row from the codec, the id and the ids; schema describes it."""

    def make():
        bpe = codec(path)

        def work(ids: list, texts: list) -> dict[str, list]:
            rows = [finish(bpe, i, bpe.encode(t)) for i, t in zip(ids, texts, strict=True)]
            return {k: [r[k] for r in rows] for k in rows[0]} if rows else {}

        return work

    return per_text(keyed_texts(docs, id_col, text_col), make, schema)
