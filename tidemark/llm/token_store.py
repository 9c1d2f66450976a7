"""Token-id shards with a minimal perfect hash index (operator 7).

Documents are dealt by ranges of doc_id (and of the beginning of their text, so that one hot
doc_id, null included, is many tasks), encoded with the tokenizers library, and
each partition writes one shard: raw little-endian ids, then an index, then a
footer. The index maps a document key to its run of ids: a minimal perfect hash
(levels of collision-free bits, ranked by popcount) gives the key's slot, the slot
holds a fingerprint that tells foreign keys apart, and the offset of the ids.
The fingerprint is a bijection of the key, so that it tells every foreign key apart and the keys need
not be stored beside it. Keyed access takes constant time in a shard and reads only the ids asked for; the
manifest names the least and greatest key of each shard.

A shard is written under a name of its own attempt. Only attempts that succeed get into the manifest, files of
others are deleted once it stands; nothing is renamed, so a lost executor or a second attempt does no harm.

Defined cases: null or empty text gives only the end id; rows with a null doc_id come
first, are counted and read back but are not in the index; rows that share a doc_id
follow each other, ordered by text, in one shard or several, and a key gives all of them.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed_texts, new_path, slices, stored

MAGIC = b"TIDEIDS1"
#: Chunks that a worker remembers before it forgets half of them.
CACHED = 1_000_000
#: Two white spaces in a row, white space but space and line feed, NUL (the mark of a text's start). Fixed value.
ODD_SPACE = r"[ \n][ \n]|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes that are encoded together; new chunks that go to the library as one text.
TOGETHER, LINES = 1 << 23, 64
#: Bits of a level of the hash for each key that is left.
GAMMA = 2.0


class IdTable:
    """Chunks that a worker remembers: an Arrow array of them, and their ids as runs of one array. It grows from slice to slice."""

    def __init__(self, dtype: str):
        self.chunks = pa.array([], pa.string())
        self.flat, self.starts, self.seen = np.zeros(1 << 16, dtype), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used, self.turn = 0, 0

    def find(self, chunks: pa.Array) -> np.ndarray:
        """Number of each chunk, -1 where it is not known."""
        return pc.fill_null(pc.index_in(chunks, self.chunks), -1).to_numpy().astype(np.int64)

    def add(self, chunks: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Adds different new chunks whose ids follow each other in flat."""
        n, m = len(self.chunks), len(chunks)
        self.flat, self.starts, self.seen = grown(self.flat, self.used + len(flat)), grown(self.starts, n + m + 1), grown(self.seen, n + m)
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[n + 1 : n + m + 1] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.chunks = pa.concat_arrays([self.chunks, chunks])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of known chunks, one after the other, and how many each has."""
        first = self.starts[numbers]
        sizes = self.starts[numbers + 1] - first
        places = np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        places += np.arange(len(places))
        return self.flat[places], sizes

    def use(self, numbers: np.ndarray) -> None:
        self.turn += 1
        self.seen[numbers] = self.turn

    def forget(self, most: int) -> None:
        """Keeps about `most` chunks, those of the latest slices."""
        seen = self.seen[: len(self.chunks)]
        keep = np.flatnonzero(seen > np.partition(seen, -most)[-most])
        flat, sizes = self.gather(keep)
        chunks, seen = self.chunks.take(pa.array(keep)), seen[keep]
        self.chunks, self.used = chunks.slice(0, 0), 0
        self.add(chunks, flat, sizes)
        self.seen[: len(keep)] = seen


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a copy of at least twice its size if it has no room for n."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class ShardEncoder:
    """Ids of whole texts by the tokenizers library, which sees each different space-separated chunk once while a worker remembers it.

    A byte-level vocabulary cuts a text where white space begins, so what stands between two single spaces is encoded
    alike wherever it stands. New chunks go to the library many in one text, a line end and a space between two,
    and the id of the line end tells them apart. Texts with other white space or special tokens go through the library whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.by_chunk = not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.odd = "|".join([ODD_SPACE, *(re.escape(x["content"]) for x in spec["added_tokens"])])
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.end = np.array([end_id], self.dtype).tobytes()
        line_end = self.library(["\n"])[0]
        self.by_chunk = bool(self.by_chunk and len(line_end) == 1)
        self.line_end = line_end[0]
        self.known = IdTable(self.dtype)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts have no two white spaces in a row, none but space and newline, and no special token."""
        if not self.by_chunk:
            return np.zeros(len(texts), bool)
        return ~pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)

    def together(self, chunks: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without white space, each behind lead (a space or nothing), one after the other, and how many each has."""
        if not len(chunks):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        offsets = pa.array(np.append(np.arange(0, len(chunks), LINES), len(chunks)), pa.int32())
        rows = pc.binary_join(pa.ListArray.from_arrays(offsets, chunks), f"\n{lead}").to_pylist()
        ids = np.concatenate([np.append(x, self.line_end) for x in self.library([lead + r for r in rows])]).astype(self.dtype)
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(chunks):
            raise ValueError("the vocabulary joins line ends with what stands next to them")
        return ids[ids != self.line_end], np.diff(ends, prepend=-1) - 1

    def learn(self, chunks: pa.Array) -> None:
        """Adds chunks that the table lacks.

        A chunk stands behind a space unless it begins with a line end or with NUL, which marks the start of a text.
        """
        line, start = pc.starts_with(chunks, "\n"), pc.starts_with(chunks, "\0")
        for mark, lead, own in ((line, "", [self.line_end]), (start, "", []), (pc.invert(pc.or_(line, start)), " ", [])):
            part = chunks.filter(mark)
            if not len(part):
                continue
            bare = part if lead else pc.utf8_slice_codeunits(part, 1)
            some = pc.not_equal(pc.binary_length(bare), 0)
            flat, sizes = self.together(bare.filter(some), lead)
            every = np.zeros(len(part), np.int64)
            every[some.to_numpy(zero_copy_only=False)] = sizes
            if own:
                flat, every = np.insert(flat, np.cumsum(every) - every, own[0]), every + 1
            if lead and not pc.all(some).as_py():  # a space alone, at the end of a text
                blank = self.library([" "])[0]
                at = np.flatnonzero(every == 0)
                flat, every[at] = np.insert(flat, np.repeat((np.cumsum(every) - every)[at], len(blank)), np.tile(blank, len(at))), len(blank)
            self.known.add(part, flat, every)

    def numbers_of(self, chunks: pa.Array) -> np.ndarray:
        """Numbers of different chunks in the table."""
        if len(self.known.chunks) > CACHED:
            self.known.forget(CACHED // 2)
        found = self.known.find(chunks)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = chunks.take(pa.array(missing))
            n = len(self.known.chunks)
            self.learn(new)
            found[missing] = n + pc.index_in(new, self.known.chunks.slice(n)).to_numpy()
        self.known.use(found)
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """For each text its ids and the end id."""
        out: list[bytes] = [b""] * len(texts)
        plain = self.plain(texts)
        whole = np.flatnonzero(~plain).tolist()
        for i, ids in zip(whole, self.library([texts[i].as_py() for i in whole]), strict=True):
            out[i] = ids.tobytes()
        owners = np.flatnonzero(plain)
        rows = pc.binary_join_element_wise("\0", pc.replace_substring(texts.filter(pa.array(plain)), "\n", " \n"), "")
        ends = np.cumsum(pc.binary_length(rows).to_numpy())
        at = 0
        while at < len(rows):  # about TOGETHER bytes at a time
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
            group = rows.slice(at, end - at)
            made = self.encode_parts(group) if end - at > 1 else [b"".join(b"".join(self.encode_parts(pa.array([p]))) for p in pieces(group[0].as_py()))]
            for i, ids in zip(owners[at:end].tolist(), made, strict=True):
                out[i] = ids
            at = end
        return [x + self.end for x in out]

    def encode_parts(self, parts: pa.Array) -> list[bytes]:
        """Ids of stretches of plain texts, by way of their different chunks."""
        split = pc.split_pattern(parts, " ")
        coded = split.flatten().dictionary_encode()
        numbers = self.numbers_of(coded.dictionary)  # may begin a new table
        ids, sizes = self.known.gather(numbers[coded.indices.to_numpy()])
        raw = ids.tobytes()
        bounds = (np.append(0, np.cumsum(sizes))[split.offsets.to_numpy()] * self.width).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def pieces(text: str) -> Iterator[str]:
    """A plain text cut at spaces into stretches of about TOGETHER characters, where it has spaces."""
    while len(text) > TOGETHER and (cut := text.rfind(" ", 1, TOGETHER)) > 0:
        yield text[:cut]
        text = text[cut + 1 :]
    yield text


_ENCODERS: dict[tuple, ShardEncoder] = {}


def encoder(path: str, end_id: int) -> ShardEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = ShardEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shifts and odd multipliers) of keys under a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def unmixed(x: np.ndarray, seed: int) -> np.ndarray:
    """The keys that mixed() maps to x."""
    with np.errstate(over="ignore"):
        x = x ^ x >> np.uint64(31) ^ x >> np.uint64(62)
        x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = x ^ x >> np.uint64(27) ^ x >> np.uint64(54)
        x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        x = x ^ x >> np.uint64(30) ^ x >> np.uint64(60)
        return x - np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)


PRINT_SEED = 1 << 16


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: about 3 bits a key and a rank for each 64."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        counts = np.bitwise_count(bits).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(counts)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, words = keys.astype(np.uint64), [], []
        while len(left):
            n = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            at = (mixed(left, len(sizes)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(n)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level takes it; a foreign key may get any slot."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, n in enumerate(self.sizes):
            at = (mixed(keys[left], level) % np.uint64(n)).astype(np.int64) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out


class ShardWriter:
    """Appends documents in key order and closes with the index and the footer."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.lengths, self.keys, self.n_null = stream, width, array("q"), array("q"), 0
        self.offset = 0

    def add(self, key: int | None, ids: bytes) -> None:
        if key is None:
            self.n_null += 1
        else:
            self.keys.append(key)
        self.lengths.append(len(ids) // self.width)
        self.offset += len(ids)
        self.stream.write(ids)

    def close(self) -> None:
        keys, lengths = np.array(self.keys, np.int64), np.array(self.lengths, np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        distinct, first, runs = np.unique(keys, return_index=True, return_counts=True)
        index = PerfectHash.build(distinct.view(np.uint64))
        slots = index.slots(distinct.view(np.uint64))
        row, prints, run = (np.zeros(len(distinct), t) for t in ("<u4", "<u8", "<u4"))
        row[slots], run[slots] = first + self.n_null, runs
        prints[slots] = mixed(distinct.view(np.uint64), PRINT_SEED)
        arrays = {"starts": starts, "bits": index.bits, "row": row, "run": run, "prints": prints}
        spec = {"width": self.width, "n_null": self.n_null, "sizes": index.sizes, "arrays": {}}
        for name, a in arrays.items():
            raw = a.tobytes()
            spec["arrays"][name] = [self.offset, len(raw), a.dtype.str]
            self.stream.write(raw)
            self.offset += len(raw)
        foot = json.dumps(spec).encode()
        self.stream.write(foot + len(foot).to_bytes(8, "little") + MAGIC)


class ShardReader:
    """Reads a shard by position or by key; f is a random-access file."""

    def __init__(self, f):
        self.f, size = f, f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token-id shard")
        n = int.from_bytes(tail[:8], "little")
        spec = json.loads(f.read_at(n, size - 16 - n))
        got = {k: np.frombuffer(f.read_at(m, at), t) for k, (at, m, t) in spec["arrays"].items()}
        self.starts, self.row, self.run, self.prints = (got[k] for k in ("starts", "row", "run", "prints"))
        self.n_null, self.width, self.index = spec["n_null"], spec["width"], PerfectHash(spec["sizes"], got["bits"])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key, through the index; 0 rows where a key is absent."""
        raw = np.asarray(keys, np.int64).view(np.uint64)
        slots = self.index.slots(raw)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == mixed(raw[ok], PRINT_SEED)
        row, run = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        row[ok], run[ok] = self.row[slots[ok]], self.run[slots[ok]]
        return row, run

    def keys(self) -> np.ndarray:
        """The key of each row that has one, in order, out of the fingerprints."""
        order = np.argsort(self.row)
        return np.repeat(unmixed(self.prints[order].astype(np.uint64), PRINT_SEED).view(np.int64), self.run[order])

    def ids(self, first: int, count: int = 1) -> np.ndarray:
        """Ids of rows first .. first + count - 1."""
        at, end = int(self.starts[first]), int(self.starts[first + count])
        return np.frombuffer(self.f.read_at((end - at) * self.width, at * self.width), "<u2" if self.width == 2 else "<u4")

    def get(self, key: int) -> list[np.ndarray]:
        """All documents stored under a key."""
        row, run = self.rows_of(np.array([key]))
        return [self.ids(int(row[0]) + i) for i in range(int(run[0]))]


MANIFEST = "shard int, path string, n_docs long, n_ids long, first_key long, last_key long"


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as shards below folder in ascending id order. Returns a row per shard: shard, path, n_docs, n_ids, first_key, last_key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        system, place = fs.FileSystem.from_uri(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        out = writer = None
        for batch in batches:
            for part in slices(batch, 2048):
                if writer is None:
                    code = encoder(path, end_id)
                    system.create_dir(place, recursive=True)
                    out = system.open_output_stream(f"{place}/{name}")
                    writer = ShardWriter(out, code.width)
                for key, ids in zip(part.column(0).to_pylist(), code.encode(part.column(1)), strict=True):
                    writer.add(key, ids)
        if writer:
            writer.close()
            out.close()
            ends = [writer.keys[0], writer.keys[-1]] if len(writer.keys) else [None, None]
            row = {"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [len(writer.lengths)], "n_ids": [sum(writer.lengths)]}
            yield pa.RecordBatch.from_pydict(row | {n: pa.array([k], pa.int64()) for n, k in zip(("first_key", "last_key"), ends, strict=True)})

    rows = keyed_texts(docs, id_col, text_col)
    dealt = rows.repartitionByRange("doc_id", F.left("text", F.lit(32))).sortWithinPartitions("doc_id", "text")
    shards = stored(dealt.mapInArrow(run, MANIFEST), "shards")
    drop_others(shards, folder)
    return shards


def drop_others(shards: DataFrame, folder: str) -> None:
    """Deletes what attempts that did not succeed left in the folder: a name a shard is all that is collected."""
    spark = shards.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(jpath):
        good = {r.path.rsplit("/", 1)[-1] for r in shards.select("path").collect()}
        for status in files.listStatus(jpath):
            if status.getPath().getName() not in good:
                files.delete(status.getPath(), False)


def lookup(shards: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access over all shards: doc_id, shard, part (from 0, of the documents of a shard that share it), n_tokens, ids. keys: a column of keys; each is looked up once.

    The manifest's key ranges send a key to the shards that may hold it (mostly one); the index does the rest. Ranges meet keys by
    an equi join over blocks of keys, about four times as many as shards.
    """
    wanted = keys.select(F.col(key).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    low, high, n = shards.agg(F.min("first_key"), F.max("last_key"), F.count("*")).first()
    size = 1 if low is None else (high - low) // (4 * n) + 1
    block = lambda c: F.floor(F.col(c) / F.lit(size))
    ranges = shards.filter("first_key IS NOT NULL").select("shard", "path", "first_key", "last_key", F.explode(F.sequence(block("first_key"), block("last_key"))).alias("block"))
    near = wanted.withColumn("block", block("doc_id")).join(ranges, "block").filter("doc_id BETWEEN first_key AND last_key")
    names = ["doc_id", "shard", "part", "n_tokens", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, stream = None, None, None
        for batch in batches:
            out = []
            for uri, shard, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if uri != last:
                    if stream:
                        stream.close()
                    system, place = fs.FileSystem.from_uri(uri)
                    stream = system.open_input_file(place)
                    reader, last = ShardReader(stream), uri
                out += [(key, shard, i, ids) for i, ids in enumerate(reader.get(key))]
            columns = [pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.int32()) for i in (1, 2)), pa.array([len(r[3]) for r in out], pa.int64()), pa.array([r[3].astype(np.int64) for r in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if stream:
            stream.close()

    met = near.repartition("path").sortWithinPartitions("path", "doc_id").select("path", "shard", "doc_id")
    return met.mapInArrow(run, "doc_id long, shard int, part int, n_tokens long, ids array<long>")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit ids)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_file(place) as f:
                    reader = ShardReader(f)
                    keys = reader.keys()
                    for at in range(0, len(reader), 512):
                        yield pa.RecordBatch.from_arrays(described(reader, keys, at, min(512, len(reader) - at), base), names=names)

    n = max(1, shards.count())
    return placed.select("path", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def described(reader: ShardReader, every_key: np.ndarray, at: int, n: int, base: int) -> list[pa.Array]:
    """Columns of read_shards for n rows from row at; rows with a key are found through the index."""
    nulls = max(0, min(n, reader.n_null - at))
    keys = every_key[at + nulls - reader.n_null : at + n - reader.n_null]
    first, run = reader.rows_of(keys)
    turn = np.arange(at + nulls, at + n) - first  # which of the rows of its key
    if (run <= turn).any() or (turn < 0).any():
        raise ValueError("the index misses a key")
    rows = np.concatenate([np.arange(at, at + nulls), first + turn]).astype(np.int64)
    block, start = reader.ids(at, n).astype("<u4"), reader.starts
    crcs = [zlib.crc32(block[start[r] - start[at] : start[r + 1] - start[at]]) for r in rows]
    return [pa.array([None] * nulls + keys.tolist(), pa.int64()), pa.array(start[rows] + base), pa.array(start[rows + 1] - start[rows]), pa.array(crcs, pa.int64())]


def token_store(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes the shards into the shared folder. Returns their manifest and the folder."""
    folder = new_path(spark, "token-ids")
    return write_shards(docs, path, folder, end_id, id_col, text_col), folder
