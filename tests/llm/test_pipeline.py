"""The pipeline against a plain version of its stages on a small corpus."""

import random
import re

import pytest
from tokenizers import Tokenizer

from .test_near_copies import brute_groups
from .test_operators import WORD, brute_cut, brute_distance, junk

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def cut_text(rows):
    """Texts without the bytes that a 50-byte string of a smaller document covers."""
    least = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], d), d)
    out = {}
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_run(spark, tmp_path):
    draw = random.Random(9)
    items = [junk(draw, "good")[:150] for _ in range(4)]
    passage = junk(draw, "good")
    rows = []
    for i in range(160):
        kind = draw.choice(["shout", "marks", "good", "good", "good"])
        rows.append([i, junk(draw, kind), int(kind == "good")])
    for i in (10, 20, 30):
        rows[i] = [i, rows[40][1], rows[40][2]]
        rows[i + 1] = [i + 1, junk(draw, "good") + " " + passage, 1]
        rows[i + 2] = [i + 2, junk(draw, "good") + " " + items[0] + " end", 1]
    table = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table("documents", [(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table("labels", [(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    table("benchmark", list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t, good in rows if good]  # kinds of junk that the classifier tells apart without an error
    groups = brute_groups([t for _, t in left])
    left = [x for n, x in enumerate(left) if groups[n] == n]
    texts = cut_text(left)
    assert brute_cut(left)[0][0] == min(texts)
    words = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    clean = {i: t for i, t in texts.items() if all(brute_distance(words(x), words(t)) > len(words(x)) // 10 for x in items)}
    lib = Tokenizer.from_file(WORD)
    want = {i: (len(ids := lib.encode(t, add_special_tokens=False).ids), ids, lib.decode(ids, skip_special_tokens=False)) for i, t in clean.items()}
    assert got == want and 20 < len(want) < len(left)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "decontamination", "tokens"]


ODD = "doc_id long, text string, lang string, source string, n_chars int, node int, row string, kept string, doc int, tag int, text_hash long, score double, ids int"


def odd_rows():
    draw = random.Random(2)
    good = [junk(draw, "good") for _ in range(40)]
    texts = [*good, good[3].upper().replace("!!", ""), None, "", " ", good[5], "word " * 60_000]
    rows = [(i, t, "en", "s", len(t or ""), 1, "r", "k", 2, 3, 4, 0.5, 6) for i, t in enumerate(texts)]
    rows += [(None, good[7] + " tail", *rows[0][2:]), (None, junk(draw, "good"), *rows[0][2:]), (3, junk(draw, "good"), *rows[0][2:]), rows[8], rows[8], (9, None, None, None, None, None, None, None, None, None, None, None, None)]
    junk_rows = [(1000 + i, junk(draw, "shout"), *rows[0][2:]) for i in range(30)]
    return rows + junk_rows


def write(spark, folder, rows):
    spark.createDataFrame(rows, ODD).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] < 1000), 0) for r in rows if r[0] is not None] + [(None, 1, 0), (5, None, None)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, rows[12][1][:90]), (1, None), (2, "")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated ids and rows, clashing columns, a long text: every stage keeps the columns, and clean rows stay."""
    write(spark, str(tmp_path), odd_rows())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    schema, counts, ids = docs.schema, [], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "test")
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in schema]
        found = docs.collect()
        counts.append(len(found))
        ids.append(sorted((r.doc_id is None, r.doc_id or 0) for r in found))
    quality, near, repeats, clean = ids
    assert not any(1000 <= i for _, i in quality) and sum(n for n, _ in quality) == 2
    assert near.count((False, 8)) == 1 and near.count((False, 3)) == 2 and (False, 40) not in near and repeats == near
    assert (False, 12) in repeats and (False, 12) not in clean and counts[3] == counts[2] - 1
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == counts[3] and out.columns[:2] == ["doc_id", "n_tokens"]


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
