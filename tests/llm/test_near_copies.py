"""The pipeline's near-duplicate stage against brute force on planted copies with edited words."""

import random

import pytest

from tidemark.llm import near_copies, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(texts):
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited_words(draw, words, n):
    words = list(words)
    for _ in range(n):
        i, kind = draw.randrange(len(words)), draw.randrange(3)
        words[i : i + 1] = [["new%d" % draw.randrange(999)], [], [words[i], "more%d" % draw.randrange(999)]][kind]
    return " ".join(words)


def planted():
    draw = random.Random(12)
    texts, fresh = [], lambda n: ["w%d" % draw.randrange(3000) for _ in range(n)]
    for n in (4, 12, 40, 90, 150, 300):
        for _ in range(6):
            base = fresh(n)
            texts.append(" ".join(base))
            texts += [edited_words(draw, base, draw.randint(1, max(1, n // 30))) for _ in range(4)]
    hot = fresh(60)  # a passage in many texts that are not copies, and a chain of edits whose ends are not similar
    texts += [" ".join(fresh(30) + hot + fresh(10)) for _ in range(40)]
    chain = fresh(120)
    for i in range(12):
        chain = edited_words(draw, chain, 1).split()
        texts.append(" ".join(chain))
    return [*texts, "", None, " \n", texts[3].upper(), texts[4].replace(" ", "  ")]


def test_planted_copies(spark):
    texts = planted()
    order = list(range(len(texts)))
    random.Random(13).shuffle(order)
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    want = brute_groups(texts)
    assert len(texts) - len(set(want)) > 40
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns
    assert near_copies.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_links_in_blocks(spark, monkeypatch, block):
    """Buckets that are dealt in blocks lose no link."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_copies.prints(docs)
    node = {r.doc_id: r.node for r in found.select("doc_id", "node").collect()}
    roots = {r.node: r.root for r in near_copies.links(docs, found).collect()}
    got = [roots.get(node[i], node[i]) for i in range(len(texts))]
    want = brute_groups(texts)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_planes_against_distances():
    draw = random.Random(5)
    for n in (1, 2, 9, 70):
        words = [draw.getrandbits(64) & draw.getrandbits(64) for _ in range(n)]
        planes = simhash.Planes(words)
        for radius in (0, 1, 2, 9, 16, 26, 40):
            q = draw.choice(words) ^ 1 << draw.randrange(64)
            left = draw.getrandbits(n) | 1
            assert planes.near(q, radius, left) == sum(1 << i for i, w in enumerate(words) if left >> i & 1 and (w ^ q).bit_count() <= radius)


def test_odd_rows(spark):
    """Null ids and texts, repeated ids and rows, extra columns of any name, an empty table."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(None, a, 1, "x", 1.0), (None, b, 2, "y", 2.0), (3, a.upper(), 3, "z", 3.0), (3, b + " end", 4, "w", 4.0), (3, b + " end", 4, "w", 4.0), (5, None, 5, "v", 5.0), (6, " ", 6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, row string, _hash double")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.node) for r in kept.collect()) == sorted([(3, a.upper(), 3), (3, b + " end", 4), (5, "", 5)])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
