"""Every operator against a brute-force version, a library or an exact round trip, on small fixtures with the odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import ann, bpe, chat_format, decontaminate, graph, license_scan, nbsvm, simhash, suffix_dedup, token_store, toxicity

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a  b", "ΑΣ ΣΑΣ", "İstanbul ǅ", "<|endoftext|>Hello <|startoftext|> x<|endoftext", "it's DON'T we'll ½ ² 12 3a_b", "a\x1cb \x85c​d", "é ẛ̣ 中文字 🙂👍🏽", "a" * 5000, "…–—“”" + "!" * 300, "\x00\x01", "naïve, café. Foo\nBar, baz.\n", " lead", "trail ", "\n", "ab cd, ef. " * 30, "x y"]
DOCS = "doc_id long, text string, lang string, kept string, fp string"


def frame(spark, texts, first=0):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(first + i, t, "en", "k", "f") for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(spark):
    rows = ODD + [None, None]
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, rows), WORD).collect()}
    lib = Tokenizer.from_file(WORD)
    for i, t in enumerate(rows):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].n_tokens == len(want)
        assert got[i].decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(empty(spark), WORD).count() == 0


def test_bpe_random_words():
    lib, own, draw = Tokenizer.from_file(WORD), bpe.WordBpe(WORD), random.Random(1)
    texts = ["".join(draw.choice("abcdéñßthein '.,!🙂Σ") for _ in range(draw.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_token_store_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (5, "again"), (77, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards, folder = token_store.token_store(spark, docs, BYTE)
    got = token_store.read_shards(shards).collect()
    lib, start = Tokenizer.from_file(BYTE), 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    none, _ = token_store.token_store(spark, docs.limit(0), BYTE)
    assert token_store.read_shards(none).count() == 0


def test_keyed_access(spark, tmp_path):
    from pyarrow import fs

    keys = sorted({random.Random(3).randrange(-(1 << 62), 1 << 62) for _ in range(2000)} | set(range(50)))
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "s")) as out:
        w = token_store.ShardWriter(out, 2)
        w.add(None, b"\x07\x00")
        for k in keys:
            w.add(k, np.array([k & 0xFF, 1], "<u2").tobytes())
        w.add(keys[-1], b"\x09\x00")
        w.close()
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "s")) as f:
        r = token_store.ShardReader(f)
        assert r.keys().tolist() == [*keys, keys[-1]]
        assert sorted(r.index.slots(np.array(keys, np.int64).view(np.uint64)).tolist()) == list(range(len(keys)))  # minimal and perfect
        for k in (*keys[:50], *keys[-50:-1]):
            assert [x.tolist() for x in r.get(k)] == [[k & 0xFF, 1]]
        assert len(r.get(keys[-1])) == 2 and r.get(123456789) == []


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash(spark, bucket):
    draw = random.Random(2)
    base = [" ".join(draw.choice(["the", "of", "Éa", "TH", "in", "x."]) for _ in range(draw.randint(0, 12))) for _ in range(60)]
    texts = base + [base[3].upper(), base[4] + " ", "", None, " \t\n", "one", "two words", base[7] * 50]
    docs = frame(spark, texts, 10)
    prints = {10 + i: brute_print(t) for i, t in enumerate(texts)}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fp & simhash.MASK, r.component_id) for r in simhash.near_duplicates(docs, bucket=bucket).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}
    kept = simhash.keep_one(docs.union(docs.limit(5)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_links_chain(spark, bucket):
    draw = random.Random(4)
    words = {0, (1 << 64) - 1}
    for _ in range(6):  # chains of words that differ by one or two bits, dense around their start
        x = draw.getrandbits(64)
        for _ in range(40):
            words.add(x)
            y = x ^ 1 << draw.randrange(64)
            x = y if draw.random() < 0.5 else y ^ 1 << draw.randrange(64)
    fps = spark.createDataFrame([(simhash.signed(w),) for w in words], "fp long")
    found = simhash.links(fps, 2, bucket)
    roots = {r.node: r.root for r in graph.components(found).collect()}
    want = brute_components(sorted(map(simhash.signed, words)), lambda a, b: ((a ^ b) & simhash.MASK).bit_count() <= 2)
    assert {n: roots.get(n, n) for n in want} == want


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(rows):
    key = lambda d: 1 << 63 if d is None else d
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], 1 << 64), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key(d), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def repeat_rows():
    draw = random.Random(1)
    seg = ["".join(draw.choice("abé ") for _ in range(draw.randint(30, 90))) for _ in range(12)]
    rows = [(i, "".join(draw.choice(seg) for _ in range(draw.randint(0, 6)))) for i in range(120)]
    return rows + [(None, seg[0] * 3), (None, seg[1]), (5, seg[2] * 2), (5, seg[3]), (900, None), (901, ""), (902, "ab" * 400), (903, "ab" * 300 + "c"), (904, "a" * 3000), (905, "a" * 200), (906, seg[0] + seg[1]), (906, seg[0] + seg[1])]


@pytest.mark.parametrize("options", [{}, {"hot": 3, "block": 2000}, {"stretch": 97}, {"hot": 2, "block": 700, "stretch": 97}, {"sampled": 1}, {"sampled": 1, "block": 900}])
def test_suffix_dedup(spark, options, monkeypatch):
    rows = repeat_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if options.get("sampled"):
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 20_000)  # so that keys of a few chunks are hot
        core = suffix_dedup.tagged(docs).select("doc", "tag", "text")
        assert len(suffix_dedup.hot_keys(core, 512 << 10, 8 << 20, 256 << 10, 1)) > 5
    got = suffix_dedup.described(suffix_dedup.remove_repeats(docs, **options)).collect()
    assert sorted((1 << 63 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_cut(rows)


def test_suffix_dedup_keeps_rows_and_columns(spark):
    a, b = "é" * 40, "something else that is here alone and long enough to stay whole"
    docs = spark.createDataFrame([(1, a, "x", 1, 3), (2, "-" + a[:30] + b, "y", 2, 3), (3, None, None, None, None)], "doc_id long, text string, doc string, tag int, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[1].text == a and got[2].text == "-" + b and got[2].doc == "y" and got[2].tag == 2 and got[2].n_chars == len(b) + 1 and got[3].text == ""
    assert suffix_dedup.without_repeats(docs.limit(0)).columns == docs.columns and suffix_dedup.without_repeats(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    r"""Texts made of pieces of the control strings come back exactly, and the mask covers each assistant text."""
    draw, parts = random.Random(8), ["### ", "###", "</turn>", "</tur", "n>", "\\", "\\\\", "\n", "user: ", "é", " ", ":", "<\\/turn>", "x"]
    rows = [(c, t, draw.choice(["user", "assistant", "a:b\\", ""]), "".join(draw.choice(parts) for _ in range(draw.randint(0, 9)))) for c in range(60) for t in range(3)]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (99, 0, None, None), (None, 0, "assistant", "n"), (98, 1, "user", "b"), (98, 1, "user", "a"), (98, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("source", F.lit(1)).withColumn("t", F.lit(2))
    chats = chat_format.format_chats(df)
    loss = {r.conv_id: r.loss for r in chats.select("conv_id", chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for r in chats.collect():
        src = sorted(((t is not None, t or 0), role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert r.identical and [(t.role, t.text) for t in r.turns] == [(b, c) for _, b, c in src]
        assert loss[r.conv_id] == "".join(c for _, b, c in src if b == "assistant")
        assert r.formatted.count("</turn>") == len(src)
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def brute_distance(p, t):
    prev = list(range(len(p) + 1))
    best = prev[-1]
    for c in t:
        cur = [0]
        for i in range(1, len(p) + 1):
            cur.append(min(prev[i - 1] + (p[i - 1] != c), prev[i] + 1, cur[i - 1] + 1))
        prev = cur
        best = min(best, prev[-1])
    return best


def edited(draw, text, n):
    chars = list(text)
    for _ in range(n):
        i, r = draw.randrange(len(chars)), draw.random()
        if r < 0.34:
            chars[i] = draw.choice("abct")
        elif r < 0.67:
            chars.insert(i, draw.choice("abct"))
        elif len(chars) > 1:
            chars.pop(i)
    return "".join(chars)


def test_decontamination(spark):
    draw = random.Random(5)
    items = ["".join(draw.choice("abcdefgh  ") for _ in range(n)).strip() for n in (5, 25, 63, 64, 65, 129, 200, 200)]
    items = [decontaminate.normalised(x) for x in items]
    texts = ["zz " + edited(draw, x, draw.randint(0, int(len(x) * 0.14))) + " zz" for x in items for _ in range(8)] + ["", None, "clean text " * 50, "Q! ".join([*items[3].split(), ""])]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, items[2])], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find(frame(spark, texts), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in [*enumerate(items), (92, items[2])]:
            if (n := brute_distance(x, decontaminate.normalised(t))) <= decontaminate.budget(x):
                want[d, i] = n
    assert got == want
    docs = frame(spark, texts)
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == len(texts)
    assert [len(b) for b in decontaminate.blocks(bench, 100)] != [] and sum(len(b) for b in decontaminate.blocks(bench, 100)) == len(items) + 2


def test_ann(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 16)).astype(np.float32)
    x[100:900] = x[100]  # a third of the rows are one vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [1.0], 0), (5080, [None] + [1.0] * 15, 0), (20, x[20].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [*range(0, 3000, 20), 5060] and len(got.pop(5060)) == 20  # a shorter vector has zeros behind its end
    wide, hits = x.astype(np.float64), 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(abs(wide[v] @ wide[q] - s) < 1e-9 for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        s = wide @ wide[q]
        s[q] = -np.inf
        best = np.sort(s)[-20]
        hits += sum(sc >= best - 1e-9 for _, _, sc in found)
    assert hits / (20 * len(got)) >= 0.9
    few = ann.search(df.filter("vec_id < 3"), df.filter("vec_id = 0"), 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2] and ann.search(df.limit(0), df, 20).count() == 0


def test_license_scan(spark):
    texts = dict((i, t) for i, t in license_scan.known()[:12:2])
    mit = texts["MIT"]
    rows = ["Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,"), mit + " and more", "prose\nReleased under the MIT Licence.\nmore\nLicensed under CC BY-NC 4.0", "", None, "All rights reserved"]
    got = {r.doc_id: (r.license_id, r.notices) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {0: ("MIT", ["MIT"]), 1: (None, []), 2: (None, ["CC-BY-NC-4.0", "MIT"]), 3: (None, []), 4: (None, []), 5: (None, [])}
    own = spark.createDataFrame([("X-1", "My own terms."), ("X-0", "my OWN terms")], "license_id string, text string")
    assert [r.license_id for r in license_scan.scan(frame(spark, ["My own terms!"]), own).collect()] == ["X-0"]
    assert license_scan.scan(empty(spark)).count() == 0


def test_toxicity():
    draw = random.Random(6)
    counted = lambda words: dict(Counter(toxicity.fold(w) for w in words))
    word = lambda: "".join(draw.choice("abdefghknoprstuz") for _ in range(6))
    clean = [[word() for _ in range(60)] for _ in range(300)]
    toxic = [[*(word() for _ in range(60)), *draw.sample(["dumbo", "jerkface", "blockhead"], 2), "zwarg" + word()] for _ in range(80)]
    lex = toxicity.learn([counted(d) for d in toxic], [counted(d) for d in clean])
    scorer = toxicity.Scorer(lex, exceptions=["dumbo ears"])
    assert scorer.score("what a dumbo and jerkface") >= 0.7 and scorer.score("zwargling of a Zwarger") >= 0.7
    assert scorer.score("DUMB0 j3rkface") >= 0.7 and scorer.score("dumbо jеrkfacе") >= 0.7 and scorer.score("ｄｕｍｂｏ d​umbo") >= 0.7
    assert scorer.score("dumbo ears") == 0 and scorer.score("dumbostyle xdumbo") == 0 and scorer.score("") == 0
    assert scorer.score("dumbo " + "fine " * 5000) < scorer.score("dumbo fine")
    assert toxicity.learn([], []) == {} and toxicity.Scorer({}, []).score("dumbo") == 0


def junk(draw, kind):
    words = ["".join(draw.choice("aeiouthnrs") for _ in range(draw.randint(2, 8))) for _ in range(80)]
    return {"shout": " ".join(w.upper() + "!!" for w in words), "repeat": " ".join([words[0]] * 20 + [words[1]] * 20), "marks": " ".join(w + "$$$" for w in words), "good": " ".join(words).capitalize() + "."}[kind]


def test_quality_held_out(spark):
    draw = random.Random(7)
    rows = [(i, junk(draw, k := draw.choice(["shout", "repeat", "marks", "good", "good", "good"])), int(k == "good")) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "q", 1.0) for i, t, _ in rows] + [(None, None, "q", None), (1000, "", "q", None)], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1001, None)], "doc_id long, quality int")
    model = nbsvm.fit(docs, labels)
    got = {r.doc_id: r.score for r in nbsvm.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum((got[i] >= 0.3) == bool(y) for i, y in held) / len(held) >= 0.97
    assert all(0 <= s <= 1 for s in got.values())
    kept = nbsvm.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}
    assert nbsvm.fit(docs, labels.filter("quality = 1")).share == 1.0 and nbsvm.fit(docs, labels.limit(0)).share == 0.5
    assert nbsvm.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 500])
def test_features_do_not_depend_on_passes(monkeypatch, size):
    draw = random.Random(1)
    rows = [junk(draw, "good") * 3, "(" + "a" * 1500 + " b", "a a b a\n\n  B b, c", "x" * 700, "é " * 40, " lead", "trail ", "aB Ab aB", "\x00\x01", ""]
    whole = [set(nbsvm.features(t).tolist()) for t in rows]
    monkeypatch.setattr(nbsvm, "PASS_BYTES", size)
    assert [set(nbsvm.features(t).tolist()) for t in rows] == whole
    assert len(nbsvm.features("")) == 0
