"""Null ids, repeated rows, very long texts and extra columns, operator by operator."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat_format, decontaminate, license_scan, simhash, suffix_dedup

from .test_operators import brute_distance, edited

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_of_null_ids_and_long_texts(spark):
    texts = [(None, "a b"), (None, None), (1, "x" * 100_000), (1, "word, " * 50_000), (2, ""), (2, "")]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in texts], "doc_id long, text string, n_tokens int, ids string")
    lib = Tokenizer.from_file(WORD)
    want = sorted((i is None, i or 0, ids := lib.encode(t or "", add_special_tokens=False).ids, lib.decode(ids, skip_special_tokens=False)) for i, t in texts)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in bpe.encode_documents(docs, WORD).collect())
    assert got == want


def test_decontamination_of_long_texts_and_items(spark):
    draw = random.Random(3)
    letters = "abcdefghij klmnop qrstuv"
    long_item = decontaminate.normalised("".join(draw.choice(letters) for _ in range(20_000)))
    short_item = decontaminate.normalised("".join(draw.choice(letters) for _ in range(300)))
    filler = "".join(draw.choice(letters) for _ in range(400_000))
    texts = [(1, filler + edited(draw, long_item, 900) + filler), (2, filler + edited(draw, short_item, 20) + " end"), (None, filler), (2, short_item), (None, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, long_item), (11, short_item)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.find(docs, bench).collect())
    assert [x[:2] for x in found] == [(1, 10), (2, 11), (2, 11)] and found[0][2] <= 900 and found[1][2] == 0 and found[2][2] <= 20
    assert sorted(r.doc_id is None for r in decontaminate.clean(docs, bench).collect()) == [True, True]


def test_portions_are_bounded(monkeypatch):
    draw = random.Random(4)
    items = [(i, "".join(draw.choice("abcdef ") for _ in range(n)).strip()) for i, n in enumerate((30, 64, 200, 3000))]
    texts = [edited(draw, t, max(1, len(t) // 20)) for _, t in items for _ in range(6)]
    whole = decontaminate.Matcher(items).matches(texts)
    monkeypatch.setattr(decontaminate, "DISTANCE_BYTES", 1)
    assert decontaminate.Matcher(items).matches(texts) == whole and sum(map(len, whole)) >= 20
    m = decontaminate.Matcher(items)
    jobs = [(0, n, 0, 100) for n in (0, 1, 2, 3) for _ in range(3)]
    assert [len(p) for p in m.portions(jobs)] == [1] * 12
    assert all(brute_distance(items[i][1], decontaminate.normalised(t)) == d for t, f in zip(texts, whole, strict=True) for i, d, _, _ in f if i < 3)


def test_licences_of_null_ids_repeated_rows_and_long_lines(spark):
    notice = "Licensed under the MIT License"
    rows = [(None, notice), (None, "x"), (1, notice), (1, notice), (1, "other"), (2, "y " * 500_000 + "\n" + notice)]
    docs = spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.license_id or "", r.notices) for r in license_scan.scan(docs).collect())
    assert got == sorted([(True, 0, "MIT", ["MIT"]), (True, 0, "", []), (False, 1, "MIT", ["MIT"]), (False, 1, "MIT", ["MIT"]), (False, 1, "", []), (False, 2, "", ["MIT"])])


def test_chat_of_long_texts_and_many_turns(spark):
    said = "### x </turn> \\ " * 20_000
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} </turn>") for t in range(3000)] + [(2, 0, "assistant", said), (None, 0, "assistant", "no id"), (None, 1, "user", None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, start int")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    loss = "".join(t for c, _, role, t in rows if c == 1 and role == "assistant")
    assert got[1].n_turns == 3000 and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert got[2].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and (got[None].n_turns, got[None].loss_chars) == (2, 5)


def test_simhash_of_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(None, a), (None, b), (4, b), (4, a), (7, a), (7, a)]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 4, 4), (False, 4, 4), (False, 7, 4), (False, 7, 4), (True, 0, 4), (True, 0, 4)]
    alone = spark.createDataFrame([(None, a)], "doc_id long, text string")
    assert simhash.near_duplicates(alone).first().component_id is None


def test_repeats_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 60, 1, "x", 2.0), (2, "é" * 60 + "tail", 3, None, None)], "doc_id int, text string, doc int, kept string, bucket double")
    got = sorted(tuple(r) for r in suffix_dedup.without_repeats(docs).collect())
    assert got == [(1, "é" * 60, 1, "x", 2.0), (2, "tail", 3, None, None)] and suffix_dedup.without_repeats(docs).schema == docs.schema
