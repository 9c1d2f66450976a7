"""Every opN_ query over small tables: columns, thresholds, held-out rows, and the SQL of those that have it."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import nbsvm, toxicity
from tidemark.llm.registry import ORACLES, QUERIES

COLUMNS = {
    "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op6_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_token_store": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_license_scan": {"doc_id": "bigint", "canonical_sha256": "string", "license_id": "string", "notices": "string"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}
INSULTS = ("dumbo", "jerkface", "blockhead")


def word(draw):
    return "".join(draw.choice("aeiouthnrsldm") for _ in range(draw.randint(2, 8)))


def made_tables():
    draw = random.Random(11)
    docs, labels = [], []
    for i in range(240):
        words, good, toxic = [word(draw) for _ in range(draw.randint(30, 90))], i % 3 != 0, i % 4 == 0
        if toxic:
            words[5:5] = draw.sample(INSULTS, 2)
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, docs[1][1] + "\nLicensed under the MIT License\n# " + docs[2][1]), (1001, None), (1002, ""), (None, "no id here at all"), (None, None), (1003, "rows that repeat"), (1003, "rows that repeat"), (1003, "other text")]
    docs += [(1004, 'Copyright 2020 Me\n\n// This Source Code Form is subject to the terms of the\n// Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed\n// with this file, You can obtain one at https://mozilla.org/MPL/2.0/.\n//\n// x')]
    labels += [(1001, None, None), (None, 1, 1), (5, 0, 1)]
    turns = [(c, t, ("user", "assistant", "system")[t % 3], draw.choice(["### x: </turn>", "plain", "\\", "", None, "é\n</turn>\n"])) for c in range(30) for t in range(draw.randint(1, 5))]
    vectors = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(200)] + [(400, None), (420, [0.0] * 8)]
    return {
        "documents": ([(i, t, "en", "s", len(t or ""), "x", 0.0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "conversations": (turns, "conv_id long, turn long, role string, text string"),
        "embeddings": ([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, rank int"),
        "benchmark": ([(0, docs[7][1][:80]), (1, None), (2, "")], "item_id long, text string"),
    }


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """A folder with the tables and one with the same tables without rows."""
    out = []
    for n in ("full", "empty"):
        folder = tmp_path_factory.mktemp(n)
        for name, (rows, schema) in made_tables().items():
            spark.createDataFrame(rows if n == "full" else [], schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        out.append(str(folder))
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_columns_and_empty_tables(spark, folders, name):
    full, empty = (QUERIES[name](spark, f) for f in folders)
    for df in (full, empty):
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    assert full.count() > 0 and empty.count() == (1 if name == "op3_chat_format" else 0)


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, folders, name):
    con = duckdb.connect()
    for t in made_tables():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folders[0]}/{t}.parquet/*.parquet'")
    rel = con.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    got = QUERIES[name](spark, folders[0])
    if name == "op8_license_scan":  # rows that share an id are one group in SQL
        want = {r for r in rel.fetchall() if r[0] is not None and r[0] != 1003}
        assert {tuple(r[c] for c in columns) for r in got.collect() if r.doc_id is not None and r.doc_id != 1003} == want
        assert {r.doc_id: r.notices for r in got.collect() if r.notices} == {1000: "MIT", 1004: "MPL-2.0"}
    else:
        assert sorted(map(repr, rel.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


def test_probe_conversation(spark, folders):
    (r,) = [r for r in QUERIES["op3_chat_format"](spark, folders[0]).collect() if r.conv_id == -7]
    said = "\\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_fingerprints_are_hex(spark, folders):
    rows = QUERIES["op4_simhash"](spark, folders[0]).collect()
    assert len(rows) == 249 and all(len(r.fingerprint) == 16 and set(r.fingerprint) <= set("0123456789abcdef") for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (1001, 1002)} == {"0" * 16} and {r.component_id for r in rows if r.doc_id in (1001, 1002)} == {1001}


@pytest.mark.parametrize(("name", "mod", "rest", "cut"), [("op1_quality", 5, 0, 0.3), ("op9_toxicity", 3, 1, 0.7)])
def test_held_out_rows(spark, folders, name, mod, rest, cut):
    """Rows that are held out are marked, their labels are never learned from, and held-out accuracy is high."""
    rows = QUERIES[name](spark, folders[0]).collect()
    truth = {i: (q, t) for i, q, t in made_tables()["labels"][0] if i is not None and i != 5}
    for r in rows:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % mod == rest)
        assert r.predicted == int(r.score >= cut) and 0 <= r.score <= 1
    held = [(r, truth[r.doc_id]["op9" in name]) for r in rows if r.held_out and truth.get(r.doc_id, (None, None))[0] is not None]
    assert len(held) > 30 and sum(r.predicted == y for r, y in held) >= 0.95 * len(held)


def test_labels_of_held_out_rows_do_not_matter(spark, folders):
    docs, labels = (spark.read.parquet(f"{folders[0]}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned) != {}
    a, b = nbsvm.fit(docs, labels), nbsvm.fit(docs.unionAll(docs.filter("doc_id < 50")), turned)
    assert (a.weights == b.weights).all() and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


def test_coordinate_descent_against_a_plain_solver():
    """The dual solver reaches the optimum that projected gradient steps on the dense dual reach."""
    draw = np.random.default_rng(1)
    n, d = 40, 12
    x = (draw.random((n, d)) < 0.4) * draw.normal(size=(n, d))
    y = np.where(x[:, 0] + 0.3 * draw.normal(size=n) > 0, 1.0, -1.0)
    cost = np.full(n, 0.7)
    rows = [np.flatnonzero(r) for r in x]
    w, bias = nbsvm.dual_coordinate_descent(rows, [r[f] for r, f in zip(x, rows, strict=True)], y, cost, rounds=3000)
    z = np.column_stack([x, np.ones(n)]) * y[:, None]  # the bias is a feature that is always 1
    gram, alpha = z @ z.T, np.zeros(n)
    for _ in range(60_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, cost)
    plain = z.T @ alpha
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - z @ v)).sum()
    mine = np.append(w[:d], bias)
    assert abs(loss(mine) - loss(plain)) < 1e-3 * loss(plain)


def test_log_count_ratios_against_counting():
    rows, labels = [np.array([0, 3]), np.array([3]), np.array([0]), np.array([5, 0])], np.array([1, 1, -1, -1])
    got = nbsvm.log_count_ratios(rows, labels)
    pos, neg = np.ones(nbsvm.DIM), np.ones(nbsvm.DIM)
    pos[[0, 3]] += [1, 2]
    neg[[0, 5]] += [2, 1]
    want = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    lexical = nbsvm.DIM - (1 << nbsvm.LEXICAL_BITS)
    assert np.allclose(got[:lexical], want[:lexical]) and not got[lexical:].any()  # words of so few texts count nothing


def plain_hits(entries, exceptions, text):
    """A scan of the folded words one by one."""
    text, out = toxicity.fold(text), []
    words = list(toxicity.WORD.finditer(text))
    safe = set()
    for x in map(toxicity.fold, exceptions):
        for i in range(len(text)):
            if text.startswith(x, i) and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")) and not (text[i + len(x) : i + len(x) + 1].isalnum() or text[i + len(x) : i + len(x) + 1] == "_"):
                safe.update(range(i, i + len(x)))
    for m in words:
        fits = [(w, e) for e, w in entries.items() if (m[0] == e or (e[-1] == "*" and m[0].startswith(e[:-1]) and len(m[0]) > len(e) - 1))]
        if fits and m.start() not in safe:
            out.append((m.start(), max(fits, key=lambda f: (f[0], len(f[1].rstrip("*"))))[1]))
    return out


def test_hits_equal_a_plain_scan():
    draw = random.Random(4)
    entries = {"dumbo": 9.0, "jer*": 5.0, "jerk*": 6.0, "block": 7.0, "zzz": 3.0}
    scorer = toxicity.Scorer(entries, ["block party", "dumbo ears"])
    pieces = ["dumbo", "DUMB0", "jerk", "jerky", "jer", "block", "block party", "blocks", "dumbo ears", "dumbo earsx", "party", "zzz", "a", "_dumbo", "é"]
    for _ in range(300):
        text = "".join(draw.choice(pieces) + draw.choice([" ", ", ", "\n", "-"]) for _ in range(draw.randint(0, 12)))
        assert [(a, e) for a, _, e in scorer.hits(text)] == plain_hits(entries, ["block party", "dumbo ears"], text)


def test_scores_through_spark(spark):
    docs = spark.createDataFrame([(1, "a dumbo"), (1, "fine"), (None, "dumbo"), (2, None), (3, ""), (4, "dumbo " + "fine " * 200_000)], "doc_id long, text string").selectExpr("*", "'x' as score", "1 as words")
    scorer = toxicity.Scorer({"dumbo": 12.0})
    got = sorted((r.doc_id or 0, r.score) for r in toxicity.score(docs, {"dumbo": 12.0}).collect())
    assert got == sorted([(1, scorer.score("a dumbo")), (1, 0.0), (0, scorer.score("dumbo")), (2, 0.0), (3, 0.0), (4, scorer.score("dumbo " + "fine " * 200_000))])
    assert scorer.score("a dumbo") >= 0.7 and got[-1][1] < 0.7 and toxicity.score(docs.limit(0), {}).count() == 0
    assert toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")) == {}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_published_licences(spark):
    """Whole licences as a system's own copies have them, with another wrapping."""
    from pyspark.sql import functions as F

    from tidemark.llm import license_scan

    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, open(f"/usr/share/common-licenses/{f}").read()) for i, f in files.items()]
    docs = spark.createDataFrame([(n, "  ".join(t.split(" ")).upper(), i) for n, (i, t) in enumerate(rows)], "doc_id long, text string, want string")
    got = {r.doc_id: r.license_id for r in license_scan.scan(docs).collect()}
    assert got == {r.doc_id: r.want for r in docs.select("doc_id", F.col("want")).collect()}
