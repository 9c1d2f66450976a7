"""A query whose own list holds only a few copies still finds k rows."""

from collections import Counter

import numpy as np

from tidemark.llm import ann


def test_small_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHELF", 30)
    monkeypatch.setattr(ann.Lists, "tuned", lambda self, sample: 1.5)
    x = np.random.default_rng(3).normal(size=(80, 16))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    rows = [(i, x[i % 80].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(r.query_id for r in ann.search(df, df.filter("vec_id < 40"), 20).collect())
    assert got == {i: 20 for i in range(40)}
