"""Repository statistics, tool summaries and result markers."""

from pyspark.sql import functions as F

from tidemark.operators import codebase as K


def test_commits(spark):
    rows = [("a", "feat: x", "2024-01-01T1", 3, 1, "f"), ("a", "feat: x", "2024-01-01T1", 2, 0, "g"), ("b", "Revert x", "2024-01-01T2", 0, 4, "f"), ("c", "refactor y", "2024-01-03", 1, 1, "f")]
    r = K.commit_discipline(spark.createDataFrame(rows, "sha string, subject string, date string, added long, deleted long, file string")).first()
    assert (r.commits, float(r.conventional_ratio), float(r.revert_ratio), float(r.atomic_ratio), r.avg_size, r.active_days) == (3, 0.333, 0.333, 1.0, 4, 2)
    assert (float(r.deletion_ratio), float(r.refactor_ratio), float(r.per_active_day)) == (0.5, 0.333, 1.5)


def test_files(spark):
    rows = [("a/x.py", "try:\n\n  y()\nexcept ValueError:\n  pass\nexcept Exception:\n  pass\n"), ("tests/t.py", "assert 1\n"), ("evals/tests/e.rb", "rescue => e\n"), ("b.txt", "eval(1)")]
    files = spark.createDataFrame(rows, "path string, content string")
    assert {(r.language, r.kind): r.loc for r in K.loc_by_class(files).collect()} == {("python", "prod"): 6, ("python", "test"): 1, ("ruby", "eval"): 1}
    t = K.test_quality(files).first()
    assert (float(t.test_ratio), t.test_dirs) == (0.167, ["tests"])
    assert {r.language: (r.handlers, r.specific) for r in K.error_handling(files).collect()}["python"] == (2, 1)
    assert K.occurrences(files).first().eval == 1 and K.flags(files, {"tries": "try:", "none": "zzz"}).first().asDict() == {"tries": True, "none": False}
    assert K.file_lengths(files).first().longest == 6
    assert {r.component: r.n for r in K.component_counts(files, {"any": {"tests": "tests/", "python": r"\.py$"}}, "any").collect()} == {"tests": 2, "python": 2}
    assert K.config_counts(spark.createDataFrame([("c.md", "You must never do. Always test.")], "path string, content string").select("path", "content")).first().constraints >= 2


def test_messages(spark):
    m = spark.createDataFrame([(1, "no no"), (1, "yes"), (2, "no")], "s int, t string")
    assert {r.s: (r.neg, r.pos) for r in K.message_counts(m, ["s"], "t", {"neg": "no", "pos": "yes"}).collect()} == {1: (1, 1), 2: (1, 0)}
    assert [r.s for r in K.long_enough(m, ["s"], "t", 3).collect()] == [1]


def test_summaries(spark):
    show = lambda n, j: spark.range(1).select(K.tool_summary(F.lit(n), F.lit(j))).first()[0]
    assert show("Write", '{"file_path":"a","content":"é"}') == "[Tool: Write(file_path=a, content=[2 bytes])]"
    assert show("Edit", '{"file_path":"a","old_string":"x","new_string":"yz"}') == "[Tool: Edit(file_path=a, body=[1]->[2] bytes)]"
    assert show("MultiEdit", '{"file_path":"a","edits":[{"old_string":"x","new_string":"yz"},{"new_string":"q"}]}') == "[Tool: MultiEdit(file_path=a, edits=2, body=[4 bytes])]"
    assert show(" ", "{}") == "[Tool: <unknown>(<no input>)]" and show("Odd", "broken") == "[Tool: Odd([6 bytes])]"
    mark = lambda t, s=None: spark.range(1).select(K.output_marker(F.lit(t), s)).first()[0]
    stored = "<persisted-output>Output too large (87.7KB) saved to: /x/tool-results/a.txt</persisted-output>"
    assert mark("abc") == "[ToolResult: 3 bytes]" and mark(" ") is None and mark(stored) == "[ToolResult: ~87.7KB]"
    assert mark(stored, F.create_map(F.lit("a.txt"), F.lit(12))) == "[ToolResult: 12 bytes]"
    chunks = spark.createDataFrame([("s", "p", 0, "c0"), ("s", "p", 1, "c1")], "session string, parent_id string, pos int, chunk string")
    found = K.with_parent_header(chunks, spark.createDataFrame([("p", "do it")], "parent_id string, prompt string"))
    assert sorted(r.chunk for r in found.collect()) == ["[Subagent task] do it\n\nc0", "c1"]
