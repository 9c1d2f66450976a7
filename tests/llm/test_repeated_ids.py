"""Rows that share a doc_id, null included, are decided each by its own text."""

import pytest

from tidemark.llm import near_copies, simhash


@pytest.mark.parametrize("keep_one", [simhash.keep_one, near_copies.keep_one])
def test_rows_of_one_id(spark, keep_one):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, b.upper()), (5, c), (5, d), (6, c), (7, "alone"), (7, d + " "), (8, None), (8, "")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == sorted([(0, a), (1, b.upper()), (5, c), (5, d), (7, "alone"), (8, "")])
