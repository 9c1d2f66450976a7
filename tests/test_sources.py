"""Dialects, logs and events on hand-made fixtures."""

import json

import duckdb
from pyspark.sql import functions as F

from tidemark.sources import dialects as D
from tidemark.sources import events as E
from tidemark.sources import lines as L


def entries(spark, path, rows):
    text = [(path, i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]
    return L.json_entries(spark.createDataFrame(text, "path string, line_no int, line string"))


def ids(spark, ops):
    made = {"set": lambda x: {"$set": {"messages": [{"id": i, "type": "user"} for i in x]}}, "rewind": lambda x: {"$rewindTo": x}}
    rows = [made[o[0]](o[1]) if isinstance(o, tuple) else {"id": o, "type": "user", "content": "x"} for o in ops]
    return [r.id for r in D.replayed(entries(spark, "p", rows)).orderBy("place").collect()]


def test_mutation_log(spark):
    assert ids(spark, ["a", "b", "a"]) == ["a", "b"]
    assert ids(spark, ["a", "b", "c", ("rewind", "b")]) == ["a"]
    assert ids(spark, ["a", "b", ("rewind", "z")]) == []
    assert ids(spark, ["a", ("set", ["x", "y"]), "c"]) == ["x", "y", "c"]
    assert ids(spark, ["a", "b", ("rewind", "a"), "b", "a"]) == ["b", "a"]
    assert ids(spark, ["a", ("set", ["x"]), ("set", ["y", "z"]), ("rewind", "z")]) == ["y"]


def test_bad_lines_are_counted(spark):
    e = entries(spark, "p", [{"type": "user", "message": {"role": "user", "content": "hi"}}, "{broken", '"scalar"', "", "[1]"])
    r = L.skipped(e).first()
    assert (r.n_lines, r.n_skipped) == (4, 3)
    assert D.native(e).count() == 1


def test_native_entries_and_events(spark):
    rows = [
        {"type": "user", "timestamp": "t0", "message": {"role": "user", "content": "add a parser"}},
        {"type": "assistant", "model": "m1", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "src/tab.py"}}, {"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "git commit -m \"first\""}}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "go on"}, {"type": "tool_result", "tool_use_id": "t2", "content": "[main 0123abc] first\n3 passed, 1 failed"}]}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "d1", "name": "Task", "input": {"description": "look", "prompt": "p"}}, {"type": "text", "text": "Option 1 or option 2?\n- a\n- b"}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "d1", "content": [{"type": "text", "text": "TypeError: boom"}]}]}},
    ]
    found = E.session_events(D.native(entries(spark, "s", rows))).orderBy("event_index").collect()
    assert [r.type for r in found] == ["user_directive", "agent_thinking", "file_edit", "git_commit", "test_run", "user_directive", "subagent_dispatch", "agent_proposal", "subagent_return", "error_encountered"]
    by = {r.type: r for r in found}
    assert by["git_commit"].sha == "0123abc" and by["git_commit"].message == "first"
    assert (by["test_run"].framework, by["test_run"].passed, by["test_run"].failed) == ("pytest", 3, 1)
    assert by["subagent_return"].indicates_error and by["subagent_return"].tool_use_id == "d1"
    assert by["agent_proposal"].proposal_type == "options" and by["agent_proposal"].option_count == 2
    meta = E.dispatch_metadata(E.session_events(D.native(entries(spark, "s", rows)))).first()
    assert (meta.dispatches, meta.returns, meta.errors, meta.descriptions) == (1, 1, 1, ["look"])


def test_event_cap_keeps_structural(spark):
    rows = [{"type": "user", "message": {"role": "user", "content": f"m{i}"}} for i in range(5)]
    rows.append({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "d", "name": "Task", "input": {}}]}})
    found = E.session_events(D.native(entries(spark, "s", rows)), cap=3).orderBy("event_index").collect()
    assert [r.type for r in found] == ["user_directive"] * 3 + ["subagent_dispatch"] and all(r.truncated for r in found)


def test_codex(spark):
    patch = "*** Begin Patch\n*** Update File: a.py\n@@\n+x\n*** Add File: b.py\n+y\n*** End Patch"
    rows = [
        {"timestamp": "t", "type": "session_meta", "payload": {"type": "session_meta", "id": "s1"}},
        {"timestamp": "t", "type": "x", "payload": {"type": "user_message", "message": "hi"}},
        {"timestamp": "t", "type": "x", "payload": {"type": "function_call", "name": "shell", "call_id": "c", "arguments": json.dumps({"command": ["apply_patch", patch]})}},
        {"timestamp": "t", "type": "x", "payload": {"type": "function_call", "name": "update_plan", "arguments": json.dumps({"plan": [{"step": "one", "status": "done"}, {"step": "two"}]})}},
        {"timestamp": "t", "type": "x", "payload": {"type": "function_call", "name": "read_file", "arguments": json.dumps({"path": "q.py"})}},
        {"timestamp": "t", "type": "x", "payload": {"type": "function_call_output", "call_id": "c", "output": "ok"}},
        {"timestamp": "t", "type": "x", "payload": {"type": "reasoning", "summary": [{"text": "why"}]}},
        {"timestamp": "t", "type": "x", "payload": {"type": "token_count"}},
    ]
    found = D.codex(entries(spark, "p", rows)).orderBy("line_no").collect()
    assert [(r.role, [b.type for b in r.blocks]) for r in found] == [("user", ["text"]), ("assistant", ["tool_use", "tool_use"]), ("assistant", ["tool_use"]), ("assistant", ["tool_use"]), ("user", ["tool_result"]), ("assistant", ["thinking"])]
    assert [(b.name, json.loads(b.input)["file_path"]) for b in found[1].blocks] == [("Edit", "a.py"), ("Write", "b.py")]
    assert json.loads(found[2].blocks[0].input)["content"] == "- [done] one\n- [pending] two"
    assert (found[3].blocks[0].name, json.loads(found[3].blocks[0].input)) == ("Read", {"file_path": "q.py"})


def test_gemini_and_legacy(spark):
    message = {"id": "m", "type": "gemini", "timestamp": "t", "model": "g", "content": "done", "thoughts": [{"subject": "S", "description": "D"}], "toolCalls": [{"id": "c", "name": "run_shell_command", "args": {"command": "ls"}, "result": [{"functionResponse": {"response": {"output": "file"}}}]}]}
    rows = [{"sessionId": "s", "projectHash": "h"}, {"id": "u", "type": "user", "content": "hi"}, {"id": "c", "type": "user", "content": "<session_context> x"}, message]
    found = D.gemini(entries(spark, "p", rows)).orderBy("line_no", "pos").collect()
    assert [(r.role, [(b.type, b.name, b.text) for b in r.blocks]) for r in found] == [("user", [("text", None, "hi")]), ("assistant", [("thinking", None, "S: D"), ("text", None, "done"), ("tool_use", "Bash", None)]), ("user", [("tool_result", None, "file")])]
    legacy = spark.createDataFrame([("f", json.dumps({"history": [{"role": "user", "parts": [{"text": "a"}, {"text": "b"}]}, {"role": "model", "text": "c"}]}))], "path string, value string")
    assert [(r.role, r.blocks[0].text) for r in D.gemini_legacy(legacy).orderBy("line_no").collect()] == [("user", "a\nb"), ("assistant", "c")]


def test_opencode(spark):
    parts = [{"t": 2, "p": {"type": "text", "text": "later"}}, {"t": 1, "p": {"type": "reasoning", "text": "first"}}, {"t": 2, "p": {"type": "tool", "tool": "edit", "callID": "c", "state": {"status": "error", "error": "no", "input": {"filePath": "x.py"}}}}, {"t": 0, "p": 3}]
    rows = [{"type": "opencode_session_meta", "id": "s"}, {"type": "opencode_message", "message": {"role": "assistant", "time": {"created": 1735689600123}, "modelID": "m", "providerID": "p"}, "parts": parts}]
    found = D.opencode(entries(spark, "p", rows)).orderBy("pos").collect()
    assert [b.type for b in found[0].blocks] == ["thinking", "text", "tool_use"] and found[0].model == "p/m" and found[0].ts == "2025-01-01T00:00:00.123Z"
    assert json.loads(found[0].blocks[2].input) == {"file_path": "x.py"} and found[1].blocks[0].is_error and found[1].blocks[0].text == "no"


def test_cursor(spark):
    kv = [("composerData:c1", {"composerId": "c1", "fullConversationHeadersOnly": [{"bubbleId": "b1"}, {"bubbleId": "b2"}, {"bubbleId": "gone"}]}), ("bubbleId:c1:b1", {"type": 1, "text": "hi"}), ("bubbleId:b2", {"type": 2, "text": "yo", "toolFormerData": {"name": "read_file", "params": "{\"path\":\"z\"}", "result": "r", "toolCallId": "t"}})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in kv], "key string, value string")
    found = D.cursor(df).orderBy("line_no", "pos").collect()
    assert [(r.role, [b.type for b in r.blocks]) for r in found] == [("user", ["text"]), ("assistant", ["text", "tool_use"]), ("user", ["tool_result"])]


def test_detection_and_registry(spark):
    files = {"a": {"type": "opencode_session_meta"}, "b": {"timestamp": "t", "type": "session_meta", "payload": {}}, "c": {"sessionId": "s", "projectHash": "h"}, "d": {"type": "user", "message": {"role": "user", "content": "x"}}}
    rows = [(p, 1, json.dumps(v)) for p, v in files.items()]
    lines = spark.createDataFrame(rows, "path string, line_no int, line string")
    found = {r.path: r.dialect for r in D.detected(lines).collect()}
    assert found == {"a": "opencode", "b": "codex_cli", "c": "gemini_cli", "d": "native"}
    out = D.normalized(L.json_entries(lines), D.detected(lines)).collect()
    assert [(r.path, r.dialect) for r in out] == [("d", "native")]


def test_git_sources(spark):
    lines = lambda text: spark.createDataFrame([("p", i, x) for i, x in enumerate(text.split("\n"))], "path string, line_no int, line string")
    good, dropped = L.commits_tsv(lines("s1\ts\tA\ta@x\t2024-01-01\tsubject\twith tab\nbroken line"))
    assert good.first().subject == "subject\twith tab" and dropped.first().n_dropped == 1
    stat = L.numstat(lines("stray\nCOMMIT_BOUNDARY abc 2024-01-01 Ann B <a@x>\n3\t1\ta.py\n-\t-\timg.png\nCOMMIT_BOUNDARY def 2024-01-02 C <c@x>\n5\t0\tb.py"))
    totals = {r.sha: (r.added, r.deleted, r.files) for r in L.commit_totals(stat).collect()}
    assert totals == {"abc": (3, 1, ["a.py", "img.png"]), "def": (5, 0, ["b.py"])}
    assert {r.author for r in stat.collect()} == {"Ann B", "C"}
    piped = L.git_log_piped(lines("0123abc|2024-01-01|fix | pipe\n1\t2\tx")).first()
    assert (piped.sha, piped.subject, piped.added) == ("0123abc", "fix | pipe", 1)
    diff = L.diff_stats(lines("--- a/x.py\n+++ b/x.py\n+one\n-two\n+++ b/tests/t.py\n+a\n+b")).collect()
    assert {(r.file, r.added, r.deleted, r.test_added) for r in diff} == {("x.py", 1, 1, 0), ("tests/t.py", 2, 0, 2)}
    both = L.across_repos({"r1": stat, "r2": stat}, newest=4).collect()
    assert [r.key for r in both[:2]] == ["r1:def", "r2:def"] and len(both) == 4


def test_reading_and_paths(spark, tmp_path):
    d = tmp_path / "proj" / "s1" / "subagents"
    d.mkdir(parents=True)
    (d / "a1.jsonl").write_text('{"a":1}\n\n{"b":2}')
    (tmp_path / "proj" / "s1.jsonl").write_text('{"c":3}')
    found = L.read_lines(spark, str(tmp_path), recursiveFileLookup="true")
    assert L.json_entries(found).filter("ok").count() == 3
    rows = {r.session_id: r for r in L.session_paths(found.select("path").distinct()).collect()}
    assert rows["a1"].is_subagent and rows["a1"].parent_id == "s1" and rows["a1"].project == "proj" and rows["s1"].project == "proj"
    assert L.with_columns(spark.range(1), {"id": F.lit(9), "title": F.lit("?")}).columns == ["id", "title"]
    one = L.first_by_priority([spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")], ["k"])
    assert sorted((r.k, r.v) for r in one.collect()) == [(1, "a"), (2, "c")]
    assert {r.length for r in L.repo_files(spark, str(tmp_path), "*.jsonl").collect()} == {16, 7}


def test_user_text_cleaner(spark):
    texts = ["<system-reminder>x</system-reminder> real", "<local-command-stdout>", "Caveat: y", "<task-notification>\nz</task-notification>"]
    rows = [{"type": "user", "message": {"role": "user", "content": t}} for t in texts]
    assert [r.text for r in E.cleaned_user_text(D.native(entries(spark, "p", rows))).collect()] == ["real"]


def test_events_without_a_cap(spark):
    rows = [{"type": "user", "message": {"role": "user", "content": f"m{i}"}} for i in range(E.EVENT_CAP + 1)]
    rows.append({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "name": "Bash", "input": {"command": f'git commit -m "{i}"'}} for i in range(2)]}})
    rows.append({"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "[main 0123abc] 1"}]}})
    found = E.session_events(D.native(entries(spark, "s", rows)), cap=None).orderBy("event_index").collect()
    assert [r.type for r in found] == ["user_directive"] * (E.EVENT_CAP + 1) + ["git_commit"] * 2 and not any(r.truncated for r in found)
    assert [r.sha for r in found[-2:]] == [None, "0123abc"]


def test_every_event_counts(spark, tmp_path):
    from tidemark.plans import ORACLES, QUERIES

    spark.range(0, 50 * 4200, 50).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["event_types"](spark, str(tmp_path)).select("session", "type", "n").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["event_types"]).fetchall()) and sum(r.n for r in got) == 4200
