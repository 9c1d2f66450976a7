"""Sinks and the streaming forms."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark import sinks, streaming


def test_nested_documents(spark, tmp_path):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    kids = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "id int, pos int, v string")
    out = sinks.nested(parents, {"kids": kids}, "id")
    assert {r.id: [k.v for k in r.kids] for r in out.collect()} == {1: ["x", "y"], 2: []}
    sinks.write_documents(out, str(tmp_path / "d"))
    lines = [json.loads(line) for f in (tmp_path / "d").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted(x["name"] for x in lines) == ["a", "b"]


def test_idempotent_upsert_and_append(spark, tmp_path):
    table = str(tmp_path / "t")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert sinks.read_table(spark, table) is None
    sinks.merged(spark, table, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"])
    once = sinks.merged(spark, table, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "b"), (2, "c")]
    (tmp_path / "t" / "v000000009").mkdir()  # a version that never became complete
    for _ in range(2):
        sinks.merged(spark, table, new, ["k"])
    assert sorted(map(tuple, sinks.read_table(spark, table).collect())) == [(1, "b"), (2, "c")] and sinks.versions_of(spark, table) == [3, 4]
    sinks.append(new, str(tmp_path / "log"))
    sinks.append(new, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_ring_versions_routes(spark):
    r = spark.range(1).select(sinks.history_ring(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(4)).alias("a"), sinks.history_ring(F.array(F.lit(1)), F.lit(2)).alias("b")).first()
    assert r.a == [2, 3, 4] and r.b == [1, 2]
    v = sinks.versions(spark.createDataFrame([("f", 3), ("f", 1), ("g", 2)], "f string, s int"), ["f"], ["s"])
    assert sorted((x.f, x.s, x.version) for x in v.collect()) == [("f", 1, 1), ("f", 3, 2), ("g", 2, 1)]
    now = dt.datetime(2024, 2, 1)
    rows = [(1, 0, now, None), (1, 0, now, 200), (1, 5, now, 503), (1, 0, now, 503), (1, 0, now, 400), (2, 0, now, 200), (1, 0, dt.datetime(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "version int, attempts int, stashed_at timestamp, status int")
    got = df.select(sinks.replay_route(F.struct("version", "attempts", "stashed_at"), F.col("status"), F.lit(now)).alias("r"))
    assert [x.r for x in got.collect()] == ["retry", "delete", "quarantine", "retry", "quarantine", "quarantine", "expire"]


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streaming_sessions_and_first_seen(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t0), (1, 2, t0 + dt.timedelta(seconds=900)), (1, 3, t0 + dt.timedelta(seconds=1801)), (1, 3, t0 + dt.timedelta(seconds=1801)), (1, 4, t0 + dt.timedelta(days=2))]
    df = spark.createDataFrame(rows, "u int, id int, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = streaming.read_events(spark, str(tmp_path / "in"), df.schema)
    run(streaming.gap_sessions(events, "u", "ts"), "sessions", "complete")
    assert sorted(r.n_events for r in spark.table("sessions").collect()) == [1, 2, 2]
    run(streaming.first_seen(streaming.read_events(spark, str(tmp_path / "in"), df.schema), ["id"], "ts"), "seen", "append")
    assert sorted(r.id for r in spark.table("seen").collect()) == [1, 2, 3, 4]


def test_streaming_mutation_log(spark, tmp_path):
    ops = [("p", 1, "upsert", "a"), ("p", 2, "upsert", "b"), ("p", 3, "upsert", "a"), ("p", 4, "rewind", "b"), ("p", 5, "upsert", "c"), ("q", 1, "upsert", "x"), ("q", 2, "rewind", "?")]
    df = spark.createDataFrame(ops, "path string, line_no int, op string, id string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(streaming.mutation_log(streaming.read_events(spark, str(tmp_path / "in"), df.schema)), "logs", "update")
    assert {r.path: r.ids for r in spark.table("logs").collect()} == {"p": ["a", "c"], "q": []}


def test_streamed_lines_equal_the_batch(spark, tmp_path):
    from tidemark.sources import dialects, lines

    def log(*rows):
        return [json.dumps(r) for r in rows]

    up, back, reload = (lambda i: {"id": i, "type": "user"}), (lambda i: {"$rewindTo": i}), (lambda *x: {"$set": {"messages": [up(i) for i in x]}})
    files = {"a": log(up("x"), up("y"), reload("p", "q"), up("x"), back("q"), up("z")), "b": log(up("x"), back("?")), "c": log(reload("x"), reload("y", "x"), up("y"))}
    df = spark.createDataFrame([(p, i + 1, t) for p, x in files.items() for i, t in enumerate(x)], "path string, line_no int, line string")
    want = {}
    for r in dialects.replayed(lines.json_entries(df)).orderBy("path", "place").collect():
        want.setdefault(r.path, []).append(r.id)
    for i in (1, 2):  # two files, one after the other
        df.filter(f"(line_no <= 3) = ({i} = 1)").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {}
    q = streaming.mutation_log(streaming.mutation_ops(stream)).writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(lambda x, _: got.update({r.path: r.ids for r in x.collect()})).start()
    q.awaitTermination(120)
    assert got == {**want, "b": []} == {"a": ["p", "z"], "b": [], "c": ["y", "x"]}
