"""Session-log dialects to one canonical entry table.

Every dialect is a function from entries (path, line_no, v VARIANT) to canonical rows:
path, line_no, pos, role, ts, model, blocks. A block is struct(type, text, name, id, tool_use_id, input, is_error) with the tool's
input as JSON text. `NORMALIZERS` is the registry; a dialect is told by the first three lines of a file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import new_path
from .lines import get, json_entries

BLOCK = "struct<type:string,text:string,name:string,id:string,tool_use_id:string,input:string,is_error:boolean>"
#: Tool names of other dialects under their canonical name. Fixed values.
TOOLS = {"read_file": "Read", "write_file": "Write", "replace": "Edit", "edit": "Edit", "write": "Write", "read": "Read", "run_shell_command": "Bash", "bash": "Bash", "shell": "Bash", "exec_command": "Bash", "task": "Task"}
INPUT_KEYS = {"absolute_path": "file_path", "filePath": "file_path", "path": "file_path", "dir_path": "file_path"}


def block(kind: str, text: Column | None = None, name: Column | None = None, id_: Column | None = None, tool_use_id: Column | None = None, input_: Column | None = None, is_error: Column | None = None) -> Column:
    null = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return F.struct(F.lit(kind).alias("type"), null(text, "string").alias("text"), null(name, "string").alias("name"), null(id_, "string").alias("id"), null(tool_use_id, "string").alias("tool_use_id"), null(input_, "string").alias("input"), null(is_error, "boolean").alias("is_error"))


def tool_name(raw: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, raw), T.pascal(raw))


def tool_input(args: Column) -> Column:
    """Arguments as JSON text with canonical key names; {} unless they are an object."""
    entries = F.from_json(args, "map<string,string>")
    keys = F.create_map(*[F.lit(x) for kv in INPUT_KEYS.items() for x in kv])
    renamed = F.map_from_entries(F.transform(F.map_entries(entries), lambda e: F.struct(F.coalesce(F.try_element_at(keys, e["key"]), e["key"]).alias("key"), e["value"].alias("value"))))
    return F.coalesce(F.to_json(renamed), F.lit("{}"))


def flat_text(v: Column, sep: str = "\n") -> Column:
    """Text of a string, of an object's text, or of all parts of an array."""
    parts = F.try_variant_get(v, "$", "array<variant>")
    each = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))))
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), F.array_join(F.array_compact(each), sep)).when(F.startswith(kind, F.lit("OBJECT")), F.try_variant_get(v, "$.text", "string"))


def entry(role: Column | str, blocks: Column, pos: int, ts: Column, model: Column | None = None) -> Column:
    """A canonical entry, null without blocks."""
    role = F.lit(role) if isinstance(role, str) else role
    return F.when(F.size(blocks) > 0, F.struct(F.lit(pos).alias("pos"), role.alias("role"), ts.cast("string").alias("ts"), (F.lit(None) if model is None else model).cast("string").alias("model"), blocks.alias("blocks")))


def unfolded(rows: DataFrame, *entries: Column) -> DataFrame:
    """One line to its entries."""
    return rows.select("path", "line_no", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("path", "line_no", "e.pos", "e.role", "e.ts", "e.model", "e.blocks")


def some(*blocks: Column) -> Column:
    return F.array_compact(F.array(*blocks))


def if_text(text: Column, made: Column) -> Column:
    return F.when(F.trim(text) != "", made)


def native(entries: DataFrame) -> DataFrame:
    """The canonical shape itself: content is text or an array of blocks."""
    content = F.try_variant_get("v", "$.message.content", "variant")
    array = F.try_variant_get(content, "$", "array<variant>")
    field = lambda b, name, t="string": F.try_variant_get(b, f"$.{name}", t)
    made = F.transform(
        array,
        lambda b: F.struct(
            field(b, "type").alias("type"), F.coalesce(field(b, "text"), field(b, "thinking"), flat_text(F.try_variant_get(b, "$.content", "variant"), " ")).alias("text"), field(b, "name").alias("name"), field(b, "id").alias("id"),
            field(b, "tool_use_id").alias("tool_use_id"), F.to_json(F.try_variant_get(b, "$.input", "variant")).alias("input"), field(b, "is_error", "boolean").alias("is_error"),
        ),
    )
    text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    blocks = F.coalesce(F.when(text.isNotNull(), some(if_text(text, block("text", text)))), made)
    role = F.coalesce(get("v", "$.message.role"), get("v", "$.type"))
    rows = entries.filter("ok").filter(role.isin("user", "assistant"))
    return unfolded(rows, entry(role, F.coalesce(blocks, F.expr(f"cast(array() as array<{BLOCK}>)")), 0, get("v", "$.timestamp"), get("v", "$.model")))


#: Payload types that carry no turn, and patch markers. Fixed values of the dialect.
NOISE = ("token_count", "turn_context", "task_started", "task_complete", "compacted", "ghost_snapshot", "event_msg")
PATCH_FILE = r"(?m)^\*\*\* (Add File|Update File|Delete File|Move to): (.+)$"


def codex(entries: DataFrame) -> DataFrame:
    """Wrapped payloads; a patch call becomes one edit or write for each file, a plan becomes a write."""
    rows = entries.filter("ok").withColumn("p", F.coalesce(F.try_variant_get("v", "$.payload", "variant"), F.col("v"))).withColumn("kind", get("p", "$.type"))
    rows = rows.filter(F.col("kind").isNotNull() & ~F.col("kind").isin("session_meta", *NOISE))
    args = F.coalesce(get("p", "$.arguments"), F.lit("{}"))
    parsed = F.try_parse_json(args)
    command = F.coalesce(F.try_variant_get(parsed, "$.cmd", "array<string>"), F.try_variant_get(parsed, "$.command", "array<string>"))
    patch = F.when(command[0] == "apply_patch", F.array_join(F.slice(command, 2, 1 << 20), "\n"))
    op, file = F.regexp_extract_all(patch, F.lit(PATCH_FILE), 1), F.regexp_extract_all(patch, F.lit(PATCH_FILE), 2)
    edits = F.transform(F.arrays_zip(op.alias("op"), file.alias("file")), lambda x: block("tool_use", name=F.when(F.startswith(x["op"], F.lit("Add")), "Write").otherwise("Edit"), input_=F.to_json(F.struct(F.trim(x["file"]).alias("file_path")))))
    steps = F.from_json(F.to_json(F.try_variant_get(parsed, "$.plan", "variant")), "array<struct<status:string,step:string>>")
    plan = F.array_join(F.array_compact(F.concat(F.array(F.nullif(F.trim(F.try_variant_get(parsed, "$.explanation", "string")), F.lit(""))), F.transform(steps, lambda s: F.when(F.trim(s["step"]) != "", F.concat(F.lit("- ["), F.coalesce(F.nullif(s["status"], F.lit("")), F.lit("pending")), F.lit("] "), F.trim(s["step"])))))), "\n")
    name = get("p", "$.name")
    call = F.when(F.size(edits) > 0, edits).when((name == "update_plan") & (F.size(steps) > 0), F.array(block("tool_use", name=F.lit("Write"), input_=F.to_json(F.struct(F.lit("plans/plan.md").alias("file_path"), plan.alias("content")))))).otherwise(F.array(block("tool_use", name=tool_name(name), id_=get("p", "$.call_id"), input_=tool_input(args))))
    text = F.coalesce(get("p", "$.message"), flat_text(F.try_variant_get("p", "$.content", "variant")), get("p", "$.text"))
    thought = F.coalesce(get("p", "$.text"), flat_text(F.try_variant_get("p", "$.summary", "variant")))
    output = F.coalesce(flat_text(F.try_variant_get("p", "$.output", "variant")), F.to_json(F.try_variant_get("p", "$.output", "variant")))
    kind = F.col("kind")
    user = (kind == "user_message") | ((kind == "message") & (get("p", "$.role") == "user"))
    agent = (kind == "agent_message") | ((kind == "message") & (get("p", "$.role") == "assistant"))
    blocks = (
        F.when(user | agent, some(if_text(text, block("text", text))))
        .when(kind == "function_call", call)
        .when(kind == "function_call_output", some(if_text(output, block("tool_result", output, tool_use_id=get("p", "$.call_id")))))
        .when(kind.isin("reasoning", "agent_reasoning"), some(if_text(thought, block("thinking", thought))))
    )
    role = F.when(user | (kind == "function_call_output"), "user").otherwise("assistant")
    return unfolded(rows, entry(role, F.coalesce(blocks, F.expr(f"cast(array() as array<{BLOCK}>)")), 0, get("v", "$.timestamp")))


def replayed(entries: DataFrame) -> DataFrame:
    """Mutation log to messages: path, place (from 1), rec (JSON text).

    An upsert by id keeps its first place; $set.messages clears and reloads; $rewindTo drops the id and all after it, or
    everything if the id is unknown. Only operations after a file's last reset count. What an operation does depends on all before it, so a file
    is replayed by one task, in time that is linear in its operations.
    """
    v = F.col("v")
    keep = F.to_json(F.try_variant_get(v, "$.$set.messages", "variant"))
    reset = F.from_json(keep, "array<string>")
    op = F.when(reset.isNotNull(), "set").when(get("v", "$.$rewindTo").isNotNull(), "rewind").when(get("v", "$.type").isin("user", "gemini") & (get("v", "$.id") != ""), "upsert")
    rows = entries.filter("ok").withColumn("op", op).filter("op IS NOT NULL").withColumn("id", F.coalesce(get("v", "$.$rewindTo"), get("v", "$.id"))).withColumn("body", F.to_json("v")).withColumn("reload", reset)
    last = F.max(F.when(F.col("op") == "set", F.col("line_no"))).over(Window.partitionBy("path"))
    rows = rows.withColumn("_last", last).filter("_last IS NULL OR line_no >= _last")
    loaded = F.transform(F.filter(F.col("reload"), lambda m: F.coalesce(F.get_json_object(m, "$.id"), F.lit("")) != ""), lambda m: F.struct(F.lit("upsert").alias("op"), F.get_json_object(m, "$.id").alias("id"), m.alias("rec")))
    ops = F.when(F.col("op") == "set", loaded).otherwise(F.array(F.struct("op", "id", F.col("body").alias("rec"))))
    flat = rows.select("path", "line_no", F.posexplode(ops).alias("pos", "o")).select("path", "line_no", "pos", "o.op", "o.id", "o.rec")
    return flat.groupBy("path").applyInArrow(replayed_file, "path string, place int, id string, rec string")


def replay(kept: dict[str, int], order: list[str], ops: Iterable[tuple[str, str, int]]) -> None:
    """Carries operations (op, id, row) out on what is kept: the row of each id, and ids in the order of their places.

    An upsert keeps the first place; a rewind drops the id and all after it, or everything if the id is unknown; clear drops everything. Each
    id is dropped once for each time it came, so the whole is linear.
    """
    for op, i, row in ops:
        if op == "upsert":
            if i not in kept:
                order.append(i)
            kept[i] = row
        else:
            known = op == "rewind" and i in kept
            while order:
                last = order.pop()
                del kept[last]
                if known and last == i:
                    break


def replayed_file(table: pa.Table) -> pa.Table:
    """The records of one file that its operations leave, in place."""
    table = table.sort_by([("line_no", "ascending"), ("pos", "ascending")])
    kept, order = {}, []
    replay(kept, order, zip(table["op"].to_pylist(), table["id"].to_pylist(), range(len(table)), strict=True))
    found = table.take(pa.array([kept[i] for i in order], pa.int64()))
    return pa.table({"path": found["path"], "place": pa.array(range(1, len(order) + 1), pa.int32()), "id": found["id"], "rec": found["rec"]})


def gemini_records(records: DataFrame) -> DataFrame:
    """Records (path, place, rec) to an assistant entry and, if there are tool results, a user entry."""
    rows = records.select("path", F.col("place").alias("line_no"), F.try_parse_json("rec").alias("v"))
    role = F.coalesce(get("v", "$.type"), get("v", "$.role"))
    content = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "variant") for k in ("content", "parts", "text")])
    text = flat_text(content)
    thoughts = F.from_json(F.to_json(F.try_variant_get("v", "$.thoughts", "variant")), "array<struct<subject:string,description:string>>")
    thinking = F.filter(F.transform(thoughts, lambda t: F.concat_ws(": ", F.nullif(F.trim(t["subject"]), F.lit("")), F.nullif(F.trim(t["description"]), F.lit("")))), lambda t: t != "")
    calls = F.try_variant_get("v", "$.toolCalls", "array<variant>")
    name = lambda c: tool_name(F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit("")))
    used = F.transform(calls, lambda c: block("tool_use", name=name(c), id_=F.try_variant_get(c, "$.id", "string"), input_=tool_input(F.to_json(F.try_variant_get(c, "$.args", "variant")))))
    response = lambda p: F.coalesce(F.try_variant_get(p, "$.functionResponse.response.output", "string"), F.try_variant_get(p, "$.functionResponse.response.error", "string"), F.to_json(F.try_variant_get(p, "$.functionResponse.response", "variant")), F.try_variant_get(p, "$.text", "string"))
    output = lambda c: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(c, "$.result", "variant")) == "STRING", F.try_variant_get(c, "$.result", "string")), F.array_join(F.array_compact(F.transform(F.try_variant_get(c, "$.result", "array<variant>"), response)), "\n"), F.try_variant_get(c, "$.result.output", "string"))
    results = F.filter(F.transform(calls, lambda c: block("tool_result", output(c), tool_use_id=F.try_variant_get(c, "$.id", "string"))), lambda b: F.coalesce(F.trim(b["text"]), F.lit("")) != "")
    none = F.expr(f"cast(array() as array<{BLOCK}>)")
    said = some(if_text(text, block("text", text)))
    ts, model = F.coalesce(get("v", "$.timestamp"), get("v", "$.ts")), get("v", "$.model")
    blocks = F.concat(F.coalesce(F.transform(thinking, lambda t: block("thinking", t)), none), said, F.coalesce(used, none))
    is_user = role == "user"
    first = F.when(is_user, entry("user", F.when(F.startswith(F.ltrim(text), F.lit("<session_context>")), none).otherwise(said), 0, ts)).otherwise(entry("assistant", blocks, 0, ts, model))
    return unfolded(rows, first, F.when(~is_user, entry("user", F.coalesce(results, none), 1, ts)))


def gemini(entries: DataFrame) -> DataFrame:
    return gemini_records(replayed(entries))


def gemini_legacy(files: DataFrame) -> DataFrame:
    """The older form: one JSON object a file (path, value) with messages or history."""
    v = F.try_parse_json("value")
    messages = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.try_variant_get(v, "$.history", "array<variant>"))
    rows = files.select("path", F.posexplode(messages).alias("i", "m"))
    return gemini_records(rows.select("path", (F.col("i") + 1).alias("place"), F.to_json("m").alias("rec")))


def opencode(entries: DataFrame) -> DataFrame:
    """Messages with timed parts; parts are ordered by time, equal times as they stand."""
    rows = entries.filter("ok").filter(get("v", "$.type") == "opencode_message")
    role = F.when(get("v", "$.message.role") == "user", "user").otherwise("assistant")
    parts = F.try_variant_get("v", "$.parts", "array<variant>")
    keyed = F.transform(parts, lambda p, i: F.struct(F.coalesce(F.try_variant_get(p, "$.t", "double"), F.lit(0.0)).alias("t"), i.alias("i"), F.to_json(F.try_variant_get(p, "$.p", "variant")).alias("p")))
    ordered = F.transform(F.array_sort(F.filter(keyed, lambda x: F.startswith(x["p"], F.lit("{")))), lambda x: F.try_parse_json(x["p"]))
    kind = lambda p: F.try_variant_get(p, "$.type", "string")
    text = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))
    id_ = lambda p: F.coalesce(F.try_variant_get(p, "$.callID", "string"), F.try_variant_get(p, "$.id", "string"))
    agent = role == "assistant"
    made = F.transform(
        ordered,
        lambda p: F.when((kind(p) == "text") & (F.trim(text(p)) != ""), block("text", text(p)))
        .when(agent & (kind(p) == "reasoning") & (F.trim(text(p)) != ""), block("thinking", text(p)))
        .when(agent & (kind(p) == "tool"), block("tool_use", name=tool_name(F.coalesce(F.try_variant_get(p, "$.tool", "string"), F.lit(""))), id_=id_(p), input_=tool_input(F.to_json(F.try_variant_get(p, "$.state.input", "variant"))))),
    )
    status = lambda p: F.try_variant_get(p, "$.state.status", "string")
    output = lambda p: F.when(status(p) == "completed", F.try_variant_get(p, "$.state.output", "string")).when(status(p) == "error", F.try_variant_get(p, "$.state.error", "string"))
    results = F.filter(F.transform(F.filter(ordered, lambda p: agent & (kind(p) == "tool")), lambda p: block("tool_result", output(p), tool_use_id=id_(p), is_error=status(p) == "error")), lambda b: F.coalesce(F.trim(b["text"]), F.lit("")) != "")
    model_id = F.coalesce(get("v", "$.message.modelID"), get("v", "$.message.model.modelID"))
    provider = F.coalesce(get("v", "$.message.providerID"), get("v", "$.message.model.providerID"))
    model = F.when(agent & (model_id != ""), F.concat_ws("/", F.nullif(provider, F.lit("")), model_id))
    ts = T.ms_to_iso(get("v", "$.message.time.created", "long"))
    return unfolded(rows, entry(role, F.array_compact(made), 0, ts, model), entry("user", results, 1, ts))


def cursor(kv: DataFrame) -> DataFrame:
    """Key-value rows (key, value) of a conversation store: headers name their messages, which two forms of key hold."""
    heads = kv.filter(F.startswith("key", F.lit("composerData:"))).withColumn("v", F.try_parse_json("value"))
    ids = F.transform(F.try_variant_get("v", "$.fullConversationHeadersOnly", "array<variant>"), lambda h: F.try_variant_get(h, "$.bubbleId", "string"))
    rows = heads.select(F.substring_index("key", ":", -1).alias("path"), F.posexplode(ids).alias("i", "bubble"))
    long, short = kv.select(F.col("key").alias("k1"), F.col("value").alias("b1")), kv.select(F.col("key").alias("k2"), F.col("value").alias("b2"))
    rows = rows.withColumn("k1", F.concat_ws(":", F.lit("bubbleId"), "path", "bubble")).withColumn("k2", F.concat_ws(":", F.lit("bubbleId"), "bubble"))
    found = rows.join(long, "k1", "left").join(short, "k2", "left").select("path", (F.col("i") + 1).alias("line_no"), F.try_parse_json(F.coalesce("b1", "b2")).alias("v")).filter("v IS NOT NULL")
    is_user = get("v", "$.type", "int") == 1
    text, thought, tool = get("v", "$.text"), F.coalesce(get("v", "$.thinking.text"), get("v", "$.thinking")), get("v", "$.toolFormerData.name")
    call = get("v", "$.toolFormerData.toolCallId")
    used = F.when(tool.isNotNull(), block("tool_use", name=tool_name(tool), id_=call, input_=tool_input(get("v", "$.toolFormerData.params"))))
    result = get("v", "$.toolFormerData.result")
    none = F.expr(f"cast(array() as array<{BLOCK}>)")
    said = some(F.when(~is_user, if_text(thought, block("thinking", thought))), if_text(text, block("text", text)), F.when(~is_user, used))
    ts = F.coalesce(get("v", "$.createdAt"), T.ms_to_iso(get("v", "$.timingInfo.clientEndTime", "long")))
    role = F.when(is_user, "user").otherwise("assistant")
    return unfolded(found, entry(role, said, 0, ts), entry("user", F.when(~is_user, some(if_text(result, block("tool_result", result, tool_use_id=call)))).otherwise(none), 1, ts))


def detected(lines: DataFrame) -> DataFrame:
    """path, dialect: told by ordered rules from the first three lines that are not blank; native where none holds."""
    w = Window.partitionBy("path").orderBy("line_no")
    rows = lines.filter("trim(line) <> ''").withColumn("_n", F.row_number().over(w)).filter("_n <= 3").withColumn("v", F.try_parse_json("line"))
    has = lambda p: F.try_variant_get("v", p, "variant").isNotNull()
    rules = {
        "opencode": F.startswith(F.coalesce(get("v", "$.type"), F.lit("")), F.lit("opencode_")),
        "codex_cli": has("$.payload") | has("$.originator") | (get("v", "$.type") == "session_meta"),
        "gemini_cli": (has("$.sessionId") & has("$.projectHash")) | has("$.$set") | has("$.$rewindTo") | (get("v", "$.type") == "gemini"),
    }
    flags = rows.groupBy("path").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return flags.select("path", F.when(F.col("opencode"), "opencode").when(F.col("codex_cli"), "codex_cli").when(F.col("gemini_cli"), "gemini_cli").otherwise("native").alias("dialect"))


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {"native": native, "codex_cli": codex, "gemini_cli": gemini, "opencode": opencode}


def normalized(entries: DataFrame, dialects: DataFrame) -> DataFrame:
    """Entries of files in any dialect as canonical rows. entries: path, line_no, line (as json_entries gives them).

    The lines are written once, a folder for each dialect, so that the source is read once and each dialect parses only its own files.
    """
    spark, path = entries.sparkSession, new_path(entries.sparkSession, "dialects")
    tagged = entries.select("path", "line_no", "line").join(dialects, "path")
    tagged.write.partitionBy("dialect").parquet(path)
    kinds = {f.name: f.dataType.simpleString() for f in tagged.schema}
    rows = spark.read.schema(", ".join(f"{c} {kinds[c]}" for c in ("path", "line_no", "line", "dialect"))).parquet(path)
    out = None
    for name, f in NORMALIZERS.items():
        part = f(json_entries(rows.filter(F.col("dialect") == name).drop("dialect"))).withColumn("dialect", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
