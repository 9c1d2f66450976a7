"""Boundary rows of the operators on inline frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify as C
from tidemark.functions import outputs as O
from tidemark.functions import redact as R
from tidemark.functions import text as T
from tidemark.operators import aggregates as A
from tidemark.operators import chunking, memo
from tidemark.operators import links as L
from tidemark.operators import similarity as S
from tidemark.operators import windows as W

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def events(spark, seconds, kinds=None, user=1):
    rows = [(user, i, at(s) if s is not None else None, kinds[i] if kinds else "x") for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "u int, id int, ts timestamp_ntz, kind string")


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return df.select(column).first()[0]


def test_gap_sessions(spark):
    got = W.gap_sessions(events(spark, [0, 900, 1801, None]), ["u"], "ts", ["ts", "id"], 900).orderBy("start_ts").collect()
    assert [(r.start_ts, r.end_ts, r.n_events) for r in got] == [(at(0), at(900), 2), (at(1801), at(1801), 1)]


def test_active_seconds(spark):
    r = W.active_seconds(events(spark, [0, 5400, 10801]), ["u"], "ts", ["ts", "id"]).first()
    assert r.active_us == 5_400_000_000 and r.span_us == 10_801_000_000
    assert W.active_seconds(events(spark, [7]), ["u"], "ts", ["ts", "id"]).first().active_us == 0


def test_clusters(spark):
    many, single = W.clusters(events(spark, [0, 7200, 14401]), ["u"], "ts", ["ts", "id"])
    assert sorted(r.id for r in many.collect()) == [0, 1] and [r.id for r in single.collect()] == [2]


@pytest.mark.parametrize("kinds, found", [("P..U", [0]), ("P...U", []), ("PPU", [1]), ("PU", [0]), ("P.P", [])])
def test_response_lookahead(spark, kinds, found):
    df = events(spark, range(len(kinds)), kinds)
    got = W.response_lookahead(df, ["u"], ["ts"], F.col("kind") == "P", F.col("kind") == "U")
    assert [r.id for r in got.collect()] == found


def test_nearest_and_recovery(spark):
    df = events(spark, range(8), "..v.E.gE")
    near = {r.id: r.nearest for r in W.nearest_context(df, ["u"], ["ts"], F.when(F.col("kind") == "v", F.col("id"))).collect()}
    assert near == {0: 2, 1: 2, 2: None, 3: 2, 4: 2, 5: 2, 6: 2, 7: 2}
    got = W.recovery_distance(df, ["u"], ["ts"], F.col("kind") == "E", F.col("kind") == "g").collect()
    assert [(r.idx, r.distance) for r in got] == [(4, 2)]


def test_rolling_rate(spark):
    got = W.rolling_rate(events(spark, range(6), "EEE.EE"), ["u"], ["ts"], F.col("kind") == "E", 4, 0.75, 3).orderBy("id").collect()
    assert [r.tripped for r in got] == [False, False, True, True, True, True] and [r.fail_run for r in got] == [1, 2, 3, 0, 1, 2]


def test_greedy_chunks_open_only_where_allowed(spark):
    rows = [(1, i, t, o) for i, (t, o) in enumerate([(60, True), (50, False), (10, True), (200, True), (5, False)])]
    df = spark.createDataFrame(rows, "u int, i int, t int, o boolean")
    got = W.greedy_chunks(df, ["u"], ["i"], "t", "o", 100).orderBy("chunk").collect()
    assert [(r.n_rows, r.n_tokens) for r in got] == [(2, 110), (1, 10), (2, 205)]


def test_even_split_and_eviction(spark):
    df = spark.createDataFrame([(1, i, 10) for i in range(5)], "u int, i int, t int")
    assert [r.part for r in W.even_split(df, ["u"], ["i"], "t", 25).orderBy("i").collect()] == [0, 0, 0, 1, 1]
    got = W.evict_oldest(df, ["u"], "i", "t", 20, 2).filter("evicted").collect()
    assert sorted(r.i for r in got) == [0, 1, 2]


def test_result_patch(spark):
    got = W.result_patch(events(spark, range(5), "crrcr"), ["u"], ["ts"], F.col("kind") == "c", F.col("kind") == "r")
    assert [(r.idx, r.pending_idx) for r in got.orderBy("idx").collect()] == [(1, 0), (4, 3)]


def test_overlap_bounds(spark):
    a = spark.createDataFrame([(1, 0, at(3600), at(3600)), (2, 0, at(3601), None)], "a int, k int, a_start timestamp_ntz, a_end timestamp_ntz")
    b = spark.createDataFrame([(9, 0, at(-7200), at(0))], "b int, k int, b_start timestamp_ntz, b_end timestamp_ntz")
    assert [(r.a, r.b) for r in L.overlap_pairs(a, b, ["k"], 3600, 1000).collect()] == [(1, 9)]


def test_launch_window(spark):
    kids = spark.createDataFrame([(1, 0, at(1000))], "child_id int, k int, child_ts timestamp_ntz")

    def got(*offsets):
        parents = spark.createDataFrame([(i, 0, at(1000 + o)) for i, o in enumerate(offsets)], "parent_id int, k int, parent_ts timestamp_ntz")
        r = L.launches(kids, parents, ["k"]).first()
        return r.candidates, r.parent_id, r.confidence

    assert got(-300) == (1, 0, "high") and got(-301) == (0, None, "low") and got(5) == (1, 0, "high") and got(6) == (0, None, "low")
    assert got(-300, -10, -20) == (3, 1, "medium")


def test_links(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    got = L.ranked_links([("first", 1.0), ("second", 0.5)], [(pairs.filter("b = 1"), F.lit(0)), (pairs, F.lit(1))], ["a", "b"]).orderBy("b").collect()
    assert [(r.link_type, r.confidence) for r in got] == [("first", 1.0), ("second", 0.5)]
    texts = spark.createDataFrame([("fix #12",), ("see #2 and #21",)], "t string")
    numbers = spark.createDataFrame([(1,), (2,)], "n int")
    assert sorted((r.t, r.n) for r in L.mentions(texts, numbers, "t", "n").collect()) == [("fix #12", 1), ("see #2 and #21", 2)]
    paths = spark.createDataFrame([(1, "a/b/c/d"), (2, "x")], "id int, path string")
    known = spark.createDataFrame([("a", "far"), ("a/b", "near")], "path string, v string")
    assert [(r.id, r.v, r.distance) for r in L.nearest_ancestor(paths, known, "path", "id", "v").collect()] == [(1, "near", 2)]
    r = L.time_range(spark.createDataFrame([(None, None, at(1), None)], "s timestamp_ntz, e timestamp_ntz, s2 timestamp_ntz, e2 timestamp_ntz"), [("s", "e"), ("s2", "e2")]).first()
    assert r.range_start == at(1) == r.range_end
    g = spark.createDataFrame([(1,), (2,), (3,)], "g int")
    m = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "?")], "g int, sha string")
    f = spark.createDataFrame([("x", 2), ("y", 3)], "sha string, n int")
    assert {r.g: (r.total, r.source) for r in L.all_or_nothing(g, m, ["g"], "sha", f, "n").collect()} == {1: (5, "full"), 2: (None, "partial"), 3: (None, "none")}


def test_aggregates(spark):
    df = spark.createDataFrame([(1, i) for i in range(1, 21)], "g int, v int")
    r = A.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.p50, r.p95) == (11, 20)
    assert one(spark, A.floor_div(F.lit(-7), F.lit(2))) == -4
    assert str(one(spark, A.ratio(F.lit(1), F.lit(0)))) == "0.000"
    ties = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "c")], "g int, v string")
    assert {r.g: r.winner for r in A.mode_or(ties, ["g"], "v").collect()} == {1: "ambiguous", 2: "c"}
    top = A.top_k(spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("a", 3), ("c", 4)], "k string, s int"), [], "k", 2, "s", "s").orderBy("rank").collect()
    assert [(r.k, r.example) for r in top] == [("a", 1), ("b", 0)]
    tail = A.top_and_tail(spark.createDataFrame([("x", 3), ("y", 2), ("z", 1)], "k string, n int"), "k", "n", 2).orderBy("rank").collect()
    assert [(r.k, r.n) for r in tail] == [("x", 3), ("y", 2), ("(others)", 1), ("(total)", 6)]


def test_text_functions(spark):
    assert one(spark, T.truncate(F.lit("abcdefghijkl"), 10)) == "abcdefg..."
    assert [one(spark, T.word_count(F.lit(x))) for x in (" a b ", "a", "", "  ")] == [3, 1, 0, 0]
    assert [one(spark, T.normal_remote(F.lit(x))) for x in ("git@h.example:o/r.git", "https://u@h.example/o/r/", "ssh://git@h/o", " ")] == ["h.example/o/r", "h.example/o/r", "h/o", None]
    assert one(spark, T.ms_to_iso(F.lit(1735689600123))) == "2025-01-01T00:00:00.123Z"
    assert [one(spark, T.duration_seconds(F.lit(x))) for x in ("6h", "2w", "1m", "x")] == [21600, 1209600, 2592000, None]
    assert [one(spark, T.utc_offset_minutes(F.lit(x))) for x in ("2024-01-01T00:00:00+05:30", "2024-01-01T00:00:00-0800", "z")] == [330, -480, None]
    assert one(spark, T.offset_text(F.lit(-480))) == "-08:00"
    assert [one(spark, T.minutes_estimate(F.lit(x))) for x in (1, 30, 200, 500)] == [2, 2, 5, 10]
    assert [one(spark, T.number_or_null(F.lit(x))) for x in ("7.5", "x7", " 8 ")] == [7.5, None, 8.0]
    assert one(spark, T.last_tag(F.lit("<a>X</a> <A> Y </A>"), "a")) == "y" and one(spark, T.without_tag(F.lit("k <a>X</a>"), "a")) == "k"
    assert one(spark, T.replace_words(F.lit("Utilize, UTILIZE utilized utilize"), {"utilize": "use"})) == "Use, USE utilized use"
    assert [one(spark, f(F.lit("/a/b.c.py"))) for f in (T.basename, T.dirname, T.extension)] == ["b.c.py", "/a", ".py"]
    assert one(spark, T.pascal(F.lit("run_shell-command"))) == "RunShellCommand"
    assert one(spark, T.replaced_counts(F.lit("a b a"), F.lit("b"), ["a", "b"])) == {"a": 2}
    assert [r.entry for r in one(spark, T.lexicon_hits(F.lit("Very synergy!"), {"synergy": "jargon", "ery": "word"}))] == ["synergy"]
    assert one(spark, T.clean_display(F.lit("a\n\tb   c"))) == "a b c" and one(spark, T.plain_dashes(F.lit("1–2 a — b"))) == "1-2 a, b"


def test_classifiers(spark):
    assert [one(spark, C.prompt_type(F.lit(x))) for x in ("Fix it", "why so", "no, other", "it fails", "please look at it", "hm")] == ["directive", "question", "correction", "debugging", "review", "other"]
    assert [one(spark, C.episode_type(F.lit(x))) for x in ("Fix x", "a circle", "feat", "x")] == ["bugfix", "infrastructure", "feature", "implementation"]
    assert [one(spark, C.commit_type(F.lit(x))) for x in ("feat(a): b", "fix!: c", "wip")] == ["feat", "fix", "other"]
    assert one(spark, C.score_band(F.lit(8.0), F.lit(0.7))) == "excellent" and one(spark, C.score_band(F.lit(8.0), F.lit(0.69))) == "strong" and one(spark, C.score_band(F.lit(0.0), F.lit(0.1))) == "weak"
    assert [one(spark, C.charged(F.lit(x))) for x in ("fine!", "what!!", "NEVER EVER", "JSON API", "ugh", "!" * 281)] == [False, True, True, False, True, False]
    assert one(spark, C.option_count(F.lit("- a\n- b\n3. c"))) == 3 and one(spark, C.option_count(F.lit("- a"))) is None
    assert one(spark, C.counter_proposal(F.lit("please build something other entirely"), F.lit("Option 1 or option 2"))) and not one(spark, C.counter_proposal(F.lit("option 2 please because better things"), F.lit("Option 1 or option 2")))
    assert [one(spark, C.launch_command(F.lit(x))) for x in ("codex exec", "cd x && /usr/bin/gemini -p", "echo codex", "A=1 opencode run")] == [True, True, False, True]
    assert [one(spark, C.launch_cwd(F.lit(x))) for x in ("codex --cd '/a b'", "codex -C /x y", "codex")] == ["/a b", "/x", None]


def test_outputs(spark):
    r = one(spark, O.test_run(F.lit("12 examples, 2 failures, 1 pending")))
    assert (r.framework, r.passed, r.failed, r.pending) == ("rspec", 10, 2, 1)  # pending examples count as passed
    runs = ["10 examples, 1 failure", "Tests:       2 failed, 1 skipped, 3 passed, 6 total", "test result: FAILED. 5 passed; 1 failed; 0 ignored; finished in 0.1s", "=== 1 failed, 7 passed, 2 skipped in 0.12s ===", "3 passed", "Tests: 4 failed, 4 total"]
    assert [(r and (r.framework, r.passed, r.failed)) for r in (one(spark, O.test_run(F.lit("log\n" + x + "\nend"))) for x in runs)] == [("rspec", 9, 1), ("jest", 3, 2), ("cargo", 5, 1), ("pytest", 7, 1), ("pytest", 3, 0), None]
    assert [one(spark, O.commit_sha(F.lit(x))) for x in ("a\n[dev/x 0123abcd] msg", "[note] x", "[detached HEAD 1234567] y")] == ["0123abcd", None, "1234567"]
    assert [one(spark, O.branch(F.lit(x))) for x in ("On branch main\nclean", "[dev/x 0123abcd] msg", "[detached HEAD 1234567] y", "none")] == ["main", "dev/x", None, None]
    assert [one(spark, O.switched_branch(F.lit(x))) for x in ("cd a && git switch -c topic && ls", "git checkout main", "git checkout -- file", "git status")] == ["topic", "main", None, None]
    texts = ['git commit -m "say \\"hi\\" now" && x', "git commit -F - <<'END'\nfirst\n\nsecond\nEND\n", "git commit"]
    assert [one(spark, O.commit_message(F.lit(x))) for x in texts] == ['say \\"hi\\" now', "first\n\nsecond", None]
    assert one(spark, O.test_run(F.lit("Tests: 1 failed, 4 passed"))).framework == "jest" and one(spark, O.test_run(F.lit("none"))) is None
    assert one(spark, O.commit_sha(F.lit("[main (root-commit) 0123abc] x"))) == "0123abc" and one(spark, O.branch(F.lit("Switched to a new branch 'x/y'"))) == "x/y"
    assert one(spark, O.commit_message(F.lit("git commit -m 'a b'"))) == "a b" and one(spark, O.switched_branch(F.lit("git checkout -b f"))) == "f"
    d = one(spark, O.diffstat(F.lit("2 files changed, 3 insertions(+), 1 deletion(-)")))
    assert (d.files, d.insertions, d.deletions) == (2, 3, 1)
    assert one(spark, O.error_line(F.lit("ok\nTypeError: x\n"))) == "TypeError: x"


def test_redaction(spark):
    text = "see\n```ruby\na\nb\n```\n`UserModel` in app/x.rb"
    got = one(spark, R.code_redact(F.lit(text)))
    assert "[ruby code, ~2 lines]" in got and "[identifier]" in got and "[path]" in got
    again = one(spark, R.code_redact(F.lit(got)))
    assert again == got
    lines = "  return x\n  an indented remark\n\tcall();\nplain `word` and `a_b`, `longlowercaseword`, `two words` and `odd\nsee /usr/lib/x, and/or b.py\n```\ncode\n```\n```\nmore\n```"
    got = one(spark, R.code_redact(F.lit(lines)))
    assert got == "[code line]\n  an indented remark\n[code line]\nplain `word` and [identifier], [identifier], `two words` and `odd\nsee [path], and/or [path]\n[code]"
    s = one(spark, R.scrub(F.lit("https://u:p@h/x me@x.org password=abc +49 123 45678 9")))
    assert "u:p" not in s and "me@x.org" not in s and "abc" not in s and one(spark, R.scrub(F.lit(s))) == s


def test_similarity(spark):
    rows = [(1, i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])] + [(1, 90, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "g int, i int, v array<float>")
    assert [(r.i, r.position) for r in S.chains(df, ["g"], "i", "v").orderBy("i").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0 and one(spark, S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) is None


def test_chunks_lose_nothing():
    text = ("One two three. Four five!\nSix seven; eight, nine " * 60 + "\n\n") * 4 + "x" * 50
    assert "".join(chunking.chunks(text, 40, 0)) == text
    assert all(chunking.n_words(c) <= 40 for c in chunking.chunks(text, 40, 0))
    over = chunking.chunks(text, 40, 10)
    assert all(b.endswith(a) for a, b in zip(chunking.chunks(text, 40, 0), over, strict=True)) and chunking.chunks(" ") == [] == chunking.chunks(None)


def test_memo_and_upsert(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "key string, n int")
    kept = spark.createDataFrame([("a", "A", dt.datetime(2024, 1, 31)), ("c", "old", dt.datetime(2023, 1, 1))], "key string, value string, used_at timestamp")
    calls = []

    def compute(df):
        calls.append(1)
        return df.select("key", F.when(F.col("key") == "b", "B").alias("value"))

    got, table = memo.memoised(rows, kept, "key", compute, now)
    assert sorted((r.key, r.n, r.value) for r in got.collect()) == [("a", 1, "A"), ("b", 2, "B"), ("b", 3, "B"), ("c", 4, None)]
    assert sorted(r.key for r in table.filter(F.col("used_at") == now).collect()) == ["a", "b"]
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "k int, v string, o int")
    old = spark.createDataFrame([(1, "p", 0), (2, "q", 0)], "k int, v string, o int")
    assert sorted((r.k, r.v) for r in memo.upsert(old, new, ["k"], F.col("o")).collect()) == [(1, "y"), (2, "q"), (3, "z")]
    listing = spark.createDataFrame([("f", 1), ("g", 2)], "path string, mtime int")
    assert [r.path for r in memo.changed(listing, spark.createDataFrame([("f", 1), ("g", 1)], "path string, mtime int")).collect()] == ["g"]


def test_json_repair(spark):
    from tidemark.functions import jsonrepair as J

    rows = ['{"a": 1}', 'text ```json\n{"a": "}"}\n``` more', 'x {bad} {"a": "\\"}"} tail', "none", None, '[{"a": 2}]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = [r.o for r in df.select("i", J.json_object(F.col("s")).alias("o")).orderBy("i").collect()]
    assert got == ['{"a": 1}', '{"a": "}"}', '{"a": "\\"}"}', None, None, '{"a": 2}']
    arrays = [r.o for r in df.select("i", J.json_array(F.col("s")).alias("o")).orderBy("i").collect()]
    assert arrays[0] == '[{"a": 1}]' and arrays[5] == '[{"a": 2}]' and arrays[3] is None
    s = spark.sql("SELECT '{\"x\": \"7.5\", \"y\": 99, \"z\": \"no\"}' AS j").select(J.scores(F.col("j"), ["x", "y", "z", "w"]).alias("s")).first().s
    assert (s.x, s.y, s.z, s.w) == (7.5, 10.0, 5.0, 5.0)


def test_years_after_9999(spark):
    assert [one(spark, T.ms_to_iso(F.lit(ms))) for ms in (253402300799999, 253402300800000)] == ["9999-12-31T23:59:59.999Z", "10000-01-01T00:00:00.000Z"]
