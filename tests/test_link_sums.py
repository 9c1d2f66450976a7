"""Links of purchases to islands without their pairs, against brute force and the queries' SQL."""

import datetime as dt
import random

import duckdb
import pytest

from tidemark.operators import links as L
from tidemark.plans import ORACLES, QUERIES

T0 = dt.datetime(2024, 1, 1)
NAMES = ["episode_confidence", "greedy_assignment", "priority_link"]


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_counts_and_earliest_near(spark):
    draw = random.Random(3)
    points = [(i, draw.randrange(2), at(draw.randrange(0, 40) * 1800)) for i in range(60)]
    spans = [(i, draw.randrange(2), s, s + draw.choice([0, 1800, 9000, 50_000])) for i, s in enumerate(draw.randrange(0, 40) * 1800 for _ in range(40))]
    p = spark.createDataFrame([*points, (99, 0, None)], "id int, k int, ts timestamp_ntz")
    b = spark.createDataFrame([(i, k, at(s), at(e)) for i, k, s, e in spans], "b int, k int, b_start timestamp_ntz, b_end timestamp_ntz")
    for slack in (0, 3600):
        near = [(i, b, s) for i, k, t in points for b, k2, s, e in spans if k == k2 and at(s - slack) <= t <= at(e + slack)]
        counts = {r.b: r.n for r in L.counts_within(p, b, ["k"], ["b"], slack, 7200).collect()}
        assert counts == {x[0]: sum(y[1] == x[0] for y in near) for x in spans}
        first = {r.id: r.first.b for r in L.earliest_near(p, b, ["k"], ["id"], ["b"], slack).collect()}
        assert first == {i: min((s, b) for j, b, s in near if j == i)[1] for i in {x[0] for x in near}}


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Many users of one tenth at the same times; some purchases share an event_id, one has no time."""
    draw = random.Random(4)
    rows = [(i, draw.randrange(0, 400) * 900, 10 * draw.randrange(30) + draw.randrange(2), draw.choice(["purchase", "signup", "view"])) for i in range(900)]
    rows += [(i, t + 900 * n, u + n, kind) for n, (i, t, u, kind) in enumerate(rows[:40])]
    rows = [(i, at(t), u, kind, '{"k": %d}' % draw.randrange(5)) for i, t, u, kind in rows] + [(5000, None, rows[0][2], "purchase", '{"k": 3}'), (5001, None, rows[0][2], "purchase", '{"k": 77}')]
    path = str(tmp_path_factory.mktemp("crowded"))

    def write(name, rows):
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string").write.parquet(f"{path}/{name}/events.parquet")
        return f"{path}/{name}"

    return write("odd", rows), write("plain", rows[:900])


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql_on_crowded_rows(spark, crowded, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{crowded[0]}/events.parquet/*.parquet'")
    rel = con.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    want, got = rel.fetchall(), QUERIES[name](spark, crowded[0]).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_counts_make_no_pairs(spark, crowded, monkeypatch):
    seen, plain = [], L.overlap_pairs
    monkeypatch.setattr(L, "overlap_pairs", lambda a, b, *rest: seen.append(a) or plain(a, b, *rest))
    for name in NAMES[:2]:
        QUERIES[name](spark, crowded[1])
    assert sum(x.count() for x in seen) == 0  # only purchases that share an event_id are paired


def test_pairs_are_not_shuffled(spark, crowded):
    df = QUERIES["priority_link"](spark, crowded[1])
    assert df.count() == df.select("event_id", "i_user", "island").distinct().count() > 900
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "Aggregate" not in plan.split("\n+- ")[0]  # only the last part, of purchases that share an event_id, is grouped
