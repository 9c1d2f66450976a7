"""A large group of near copies just below 0.8: no plan of the pipeline's stage holds its pairs as rows."""

import random

import pytest

from tidemark.llm import near_copies

from .test_near_copies import brute_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def below(n):
    """n texts of one origin with nine new words each, so that two share about 0.74; in one of five texts these are the same nine, and one more is its own."""
    draw = random.Random(21)

    def edited(words, k):
        words = list(words)
        for at in draw.sample(range(8, len(words) - 8), k):
            words[at] = "new%d" % draw.randrange(10**9)
        return words

    base = ["w%d" % i for i in range(600)]
    core = edited(base, 9)
    return [" ".join(edited(base, 9) if i % 5 else edited(core, 1)) for i in range(n)]


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    return store, [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]


def rows_made(spark, seen):
    """(rows, node) of the joins and Python nodes of executions that are not in seen."""
    store, ids = executions(spark)
    for e in set(ids) - set(seen):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() or "Arrow" in node.name():
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        yield int(values.apply(m.accumulatorId()).replace(",", "")), node.name()


def test_no_rows_of_pairs(spark):
    texts = below(300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want, seen = brute_groups(texts), executions(spark)[1]
    assert 200 < len(set(want)) <= 241
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    made = list(rows_made(spark, seen))
    assert kept == sorted(set(want))
    assert made and max(made)[0] <= 2 * near_copies.BANDS * len(texts)


def test_sets_in_parts(spark, monkeypatch):
    """A block whose sets are dealt in parts loses no link."""
    monkeypatch.setattr(near_copies, "FIRST", 1)
    monkeypatch.setattr(near_copies, "ROOM", 8_000)
    texts = below(60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(brute_groups(texts)))
