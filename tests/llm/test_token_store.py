"""Token shards: stretches of long texts, forgotten chunks, hot ids, keyed access over all shards, files of dead attempts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_store

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    draw = random.Random(3)
    pieces = ["alpha", "été", "word,", "it's", "\nline", "x.", "12", "***", "中文", "a\nb", "Zeit", "«x»", "—", "\n"]
    made = [" ".join("".join(draw.choice(pieces) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(0, 300))) for _ in range(200)]
    return [*made, "", " ", "\n", "a ", " a", "a\n", "\na", "two  spaces", "tab\there", "<|endoftext|> x", "a" * 3000, "e\u0301 \u1680x"]


@pytest.mark.parametrize(("together", "cached"), [(1 << 24, 2_000_000), (100, 2_000_000), (1 << 24, 50), (300, 7)])
def test_encoder_equals_the_library(monkeypatch, together, cached):
    monkeypatch.setattr(token_store, "TOGETHER", together)
    monkeypatch.setattr(token_store, "CACHED", cached)
    lib, own, rows = Tokenizer.from_file(BYTE), token_store.ShardEncoder(BYTE, 0), texts()
    for at in range(0, len(rows), 40):
        part = rows[at : at + 40]
        want = [np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u2").tobytes() for t in part]
        assert own.encode(pa.array(part, pa.string())) == want


def test_mixed_has_an_inverse():
    keys = np.array([0, 1, (1 << 64) - 1, 1 << 63, 12345678901234567], np.uint64)
    for seed in (0, 5, token_store.PRINT_SEED):
        assert (token_store.unmixed(token_store.mixed(keys, seed), seed) == keys).all()


def test_hot_ids_and_lookup(spark):
    rows = [(7 if i % 3 else None, f"text number {i:03}", i) for i in range(300)] + [(i, f"own {i}", i) for i in range(1000, 1300)] + [(7, "text number 001", 0), (2000, None, 0), (-5, "minus", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    shards, folder = token_store.token_store(spark, docs, BYTE)
    got, start = sorted(token_store.read_shards(shards).collect(), key=lambda r: r.start), 0
    lib = Tokenizer.from_file(BYTE)
    ids = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 0]
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        want = np.array(ids(t), "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    asked = spark.createDataFrame([(7,), (1001,), (2000,), (999,), (7,), (None,), (-5,)], "doc_id long")
    found = sorted((r.doc_id, r.ids) for r in token_store.lookup(shards, asked).collect())
    assert found == sorted((i, ids(t)) for i, t, _ in rows if i in (7, 1001, 2000, -5))
    assert token_store.lookup(shards.limit(0), asked).count() == 0
    path = shards.first().path.removeprefix("file://")
    dead = path.rsplit("/", 1)[0] + "/shard-000000-dead.ids"
    open(dead, "w").close()
    token_store.drop_others(shards, folder)
    with pytest.raises(FileNotFoundError):
        open(dead)
    assert token_store.read_shards(shards).count() == len(rows)
