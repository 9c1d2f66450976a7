"""Lists that grow with the table, odd vectors, repeated ids, and recall on the driver's vectors."""

import os

import numpy as np
import pytest

from tidemark.llm import ann

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def brute(rows, query, k):
    """Ids and scores of the k nearest of a query (id, vector) by inner product over the longer of both lengths."""
    best = {}
    for i, v in rows:
        if i != query[0]:
            n = min(len(v), len(query[1]))
            best[i] = max(best.get(i, -np.inf), float(np.dot(np.array(v[:n], float), np.array(query[1][:n], float))))
    return sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]


def found(df, queries, k=20):
    out = {}
    for r in ann.search(df, queries, k).collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [x[i] for i in range(1, len(x) + 1)] for q, x in out.items()}


def test_dense_cluster_and_far_vectors(spark):
    draw = np.random.default_rng(2)
    x = np.concatenate([1 + 0.01 * draw.normal(size=(2990, 16)), 50 * draw.normal(size=(10, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(df, df.filter("vec_id % 20 = 0 or vec_id >= 2990"))
    assert sorted(got) == sorted({*range(0, 3000, 20), *range(2990, 3000)}) and all(len(v) == 20 for v in got.values())


def test_lengths_repeats_and_order(spark):
    draw = np.random.default_rng(5)
    rows = [(i % 150, draw.normal(size=8 if i % 7 else 5).tolist()) for i in range(300)] + [(7, [1.0] * 8)] * 200
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = found(df, df.filter("vec_id % 20 = 0"), 30)
    for q, have in got.items():
        mine = min(v for i, v in rows if i == q)
        want = brute(rows, (q, mine), 30)
        assert [i for i, _ in have] == [i for i, _ in want] and np.allclose([s for _, s in have], [s for _, s in want], rtol=0, atol=1e-9)
    assert sorted(got) == list(range(0, 150, 20))


@pytest.mark.parametrize("flat", [600, 8])
def test_means_in_two_levels(monkeypatch, flat):
    monkeypatch.setattr(ann, "FLAT", flat)
    monkeypatch.setattr(ann, "AT_ONCE", 5000)
    x = np.random.default_rng(1).normal(size=(2000, 4))
    c = ann.balanced_means(x, 40, 3)
    assert c.shape == (40, 4) and np.bincount(ann.nearest_of(x, c, np.zeros(40)), minlength=40).max() < 300


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver tables are not here")
def test_recall_on_the_driver_vectors(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = n = 0
    for q, have in found(df, df.filter("vec_id % 20 = 0")).items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.sort(s)[-20]
        assert len(have) == 20
        hits, n = hits + sum(v >= best - 1e-9 for _, v in have), n + 20
    assert n and hits / n >= 0.9
