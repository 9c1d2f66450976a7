"""Canonical entries to session events: entry, blocks, then none to several events a block, numbered in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import outputs as O
from ..functions import redact as R
from ..functions import text as T
from ..operators.windows import capped

#: Attributes of the tagged event, all nullable, and their types.
ATTRS = {
    "path": "string", "command": "string", "branch": "string", "message": "string", "sha": "string", "framework": "string", "passed": "int", "failed": "int", "pending": "int", "text": "string", "proposal_type": "string", "option_count": "int",
    "tool_use_id": "string", "description": "string", "prompt_hash": "string", "return_text_length": "int", "indicates_error": "boolean",
}
STRUCTURAL = ("subagent_dispatch", "subagent_return", "git_commit")
EVENT_CAP, TEXT_CAP, COMMAND_CAP = 3000, 2000, 5000


def event(kind: str, **attrs: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), *[(attrs[n].cast(t) if n in attrs else F.lit(None).cast(t)).alias(n) for n, t in ATTRS.items()])


def when(hit: Column, made: Column) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), made)


def block_events(b: Column, role: Column) -> Column:
    """array of the events that one block gives, in order; nulls are dropped."""
    arg = lambda k: F.get_json_object(b["input"], f"$.{k}")
    tool, is_tool, text = b["name"], b["type"] == "tool_use", F.coalesce(b["text"], F.lit(""))
    command, path = F.coalesce(arg("command"), arg("cmd"), F.lit("")), F.nullif(arg("file_path"), F.lit(""))
    shell = is_tool & F.lower(tool).isin("bash", "exec_command", "shell_command")
    result, said = b["type"] == "tool_result", b["type"] == "text"
    tests, blank = O.test_run(text), F.trim(text) == ""
    proposal = C.proposal_type(text)
    return F.array_compact(
        F.array(
            when(is_tool & (tool == "Edit") & path.isNotNull(), event("file_edit", path=path)),
            when(is_tool & (tool == "Write") & path.isNotNull(), event("file_create", path=path)),
            when(is_tool & (tool == "Read") & path.isNotNull(), event("file_read", path=path)),
            when(shell & O.switched_branch(command).isNotNull(), event("git_branch_switch", branch=O.switched_branch(command))),
            when(shell & F.contains(command, F.lit("git commit")), event("git_commit", message=O.commit_message(command))),
            when(shell & F.contains(command, F.lit("git push")), event("git_push")),
            when(shell & ~F.contains(command, F.lit("git ")) & (command != ""), event("bash_command", command=T.truncate(R.scrub(command), COMMAND_CAP))),
            when(is_tool & F.rlike(tool, F.lit("(?i)^(task|agent|subagent)$")), event("subagent_dispatch", tool_use_id=b["id"], description=arg("description"), prompt_hash=T.short_hash(F.coalesce(arg("prompt"), F.lit(""))))),
            when(result, event("subagent_return", tool_use_id=b["tool_use_id"], return_text_length=F.length(text), indicates_error=F.coalesce(b["is_error"], F.lit(False)) | O.error_line(text).isNotNull(), sha=O.commit_sha(text))),
            when(result & tests.isNotNull(), event("test_run", framework=tests["framework"], passed=tests["passed"], failed=tests["failed"], pending=tests["pending"])),
            when(result & O.error_line(text).isNotNull(), event("error_encountered", message=T.truncate(R.scrub(O.error_line(text)), TEXT_CAP))),
            when((b["type"] == "thinking") & ~blank, event("agent_thinking", text=T.truncate(R.scrub(text), TEXT_CAP))),
            when(said & (role == "assistant") & proposal.isNotNull(), event("agent_proposal", text=T.truncate(R.scrub(text), TEXT_CAP), proposal_type=proposal, option_count=C.option_count(text))),
            when(said & (role == "user") & ~blank, event("user_directive", text=T.truncate(R.scrub(text), TEXT_CAP))),
        )
    )


def session_events(entries: DataFrame, cap: int | None = EVENT_CAP) -> DataFrame:
    """session (the entry's path), event_index, ts, type and attributes, truncated.

    Results come before the directive of the same entry. A return counts only after a dispatch of its id. A commit's sha is that of the first
    result with text after it. At most cap events stay in a session; structural ones are exempt. Without a cap all stay.
    """
    blocks = entries.select(F.col("path").alias("session"), "line_no", "pos", "role", "ts", F.posexplode("blocks").alias("block_pos", "b"))
    late = (F.col("b.type") == "text").cast("int")
    rows = blocks.select("session", "line_no", "pos", late.alias("late"), "block_pos", "ts", F.posexplode(block_events(F.col("b"), F.col("role"))).alias("emit_pos", "e"))
    order = ["line_no", "pos", "late", "block_pos", "emit_pos"]
    w = Window.partitionBy("session").orderBy(*order)
    rows = rows.select("session", *order, "ts", "e.*")
    known = Window.partitionBy("session", "tool_use_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dispatched = F.coalesce(F.max((F.col("type") == "subagent_dispatch").cast("int")).over(known), F.lit(0)) == 1
    rows = rows.withColumn("_returned", F.when(F.col("type") == "subagent_return", dispatched & F.col("tool_use_id").isNotNull()).otherwise(True))
    later = Window.partitionBy("session").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)  # linear, unlike a frame to the end
    next_result = F.last(F.when((F.col("type") == "subagent_return") & (F.col("return_text_length") > 0), F.struct(F.col("sha").alias("sha"), F.struct(*order).alias("at"))), ignorenulls=True).over(later)
    next_commit = F.last(F.when(F.col("type") == "git_commit", F.struct(*order)), ignorenulls=True).over(later)
    rows = rows.withColumn("_r", next_result).withColumn("_c", next_commit)
    patched = F.when((F.col("type") == "git_commit") & (F.col("_c").isNull() | (F.col("_r.at") < F.col("_c"))), F.col("_r.sha"))
    rows = rows.withColumn("sha", patched).filter("_returned").drop("_returned", "_r", "_c")
    kept = rows.withColumn("truncated", F.lit(False)) if cap is None else capped(rows, ["session"], order, cap, F.col("type").isin(*STRUCTURAL))
    return kept.withColumn("event_index", F.row_number().over(w) - 1).select("session", "event_index", "ts", "type", *ATTRS, "truncated")


def breakdown(events: DataFrame) -> DataFrame:
    """Events by type and distinct files of each session."""
    return events.groupBy("session", "type").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("path")).alias("files"))


def dispatch_metadata(events: DataFrame) -> DataFrame:
    """Dispatches, returns, returns with errors and sorted distinct descriptions of each session."""
    d, r = F.col("type") == "subagent_dispatch", F.col("type") == "subagent_return"
    return events.groupBy("session").agg(F.count_if(d).alias("dispatches"), F.count_if(r).alias("returns"), F.count_if(r & F.col("indicates_error")).alias("errors"), F.sort_array(F.collect_set(F.when(d, F.col("description")))).alias("descriptions"))


#: Beginnings of texts that a tool or a skill puts in a user's name. Fixed values of the log format.
SYSTEM_TEXT = ("<system_instruction", "<system-reminder", "<local-command", "<command-", "[system]", "Caveat:")
SKILL_TEXT = ("Base directory for this skill:", "<!-- AUTO-GENERATED from SKILL.md")


def main_thread(entries: DataFrame, is_subagent: Column | bool = False) -> DataFrame:
    """Entries without the echoes of side threads, which a sub-session's own file consists of and keeps. entries: with v."""
    own = F.lit(is_subagent) if isinstance(is_subagent, bool) else is_subagent
    side = F.coalesce(F.try_variant_get("v", "$.isSidechain", "boolean"), F.lit(False))
    return entries.filter(~side | own)


def skill_template(text: Column) -> Column:
    """Whether a text is the expansion of a skill: it begins as one, says that it is generated, or is a page about a slash command that speaks of a skill."""
    heading = F.rlike(F.substring_index(text, "\n", 1), F.lit("^# /[A-Za-z0-9_]+:")) & F.contains(text, F.lit("\n\n"))
    return F.startswith(text, F.lit(SKILL_TEXT[0])) | F.contains(text, F.lit(SKILL_TEXT[1])) | (heading & F.contains(F.lower(text), F.lit("skill")))


def raw_user_text(entries: DataFrame) -> DataFrame:
    """Texts that people typed: cleaned, and without expanded skills."""
    return cleaned_user_text(entries).filter(~skill_template(F.col("text")))


def cleaned_user_text(entries: DataFrame) -> DataFrame:
    """User texts without system, reminder and local-command messages; notification spans are cut out. Tool-only turns drop out."""
    rows = entries.filter("role = 'user'").select("path", "line_no", "ts", F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n").alias("text"))
    text = F.trim(F.regexp_replace("text", r"(?s)<(system-reminder|task-notification)>.*?</\1>", ""))
    noise = F.lit(False)
    for mark in SYSTEM_TEXT:
        noise = noise | F.startswith(F.col("text"), F.lit(mark))
    return rows.withColumn("text", text).filter((F.col("text") != "") & ~noise)
