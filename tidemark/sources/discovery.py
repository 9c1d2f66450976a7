"""What the files around sessions tell: indexes, first prompts, headers, remotes, and the stores of other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import get

#: Lines of a file that a probe for its first prompt reads, and the length of a prompt in an index.
PROBE, PROMPT = 200, 200
#: Beginnings and marks of texts that a tool puts in front of what a person says. Fixed values of the formats.
SYNTHETIC = ("<session_context>", "<permissions instructions>", "<environment_context>", "<skills_instructions>", "AGENTS.md instructions", "You are Codex, a coding agent")


def session_index(files: DataFrame) -> DataFrame:
    """Index files (path, value: the whole text) to path, session_id, first_prompt, branch; an array, or an object with entries. A broken file gives no rows."""
    v = F.try_parse_json("value")
    entries = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.entries", "array<variant>"))
    rows = files.select("path", F.explode(entries).alias("v"))
    found = rows.select("path", get("v", "$.sessionId").alias("session_id"), get("v", "$.firstPrompt").alias("first_prompt"), get("v", "$.gitBranch").alias("branch"))
    return found.filter("session_id IS NOT NULL")


def prompt_of(v: Column) -> Column:
    """The text of a user's turn in any dialect; null for other lines."""
    p = F.coalesce(F.try_variant_get(v, "$.payload", "variant"), v)
    content = F.coalesce(F.try_variant_get(v, "$.message.content", "variant"), F.try_variant_get(p, "$.content", "variant"))
    parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string"))
    said = F.coalesce(get(p, "$.message"), F.try_variant_get(content, "$", "string"), F.nullif(F.array_join(F.array_compact(parts), "\n"), F.lit("")))
    kind, role = F.coalesce(get(p, "$.type"), F.lit("")), F.coalesce(get(v, "$.message.role"), get(p, "$.role"), F.lit(""))
    return F.when((kind == "user_message") | (kind == "user") | (role == "user"), said)


def first_prompts(lines: DataFrame, probe: int = PROBE) -> DataFrame:
    """path, first_prompt: the first turn of a user in a file's first lines that is no preamble of the tool's, cut to PROMPT characters; empty without one."""
    rows = lines.filter(F.col("line_no") <= probe).withColumn("text", prompt_of(F.try_parse_json("line")))
    made_up = F.lit(False)
    for mark in SYNTHETIC:
        made_up = made_up | F.contains("text", F.lit(mark))
    real = F.when((F.trim("text") != "") & ~made_up, F.struct("line_no", "text"))
    return rows.groupBy("path").agg(F.min(real).alias("_f")).select("path", F.coalesce(T.truncate(F.col("_f.text"), PROMPT), F.lit("")).alias("first_prompt"))


def built_index(lines: DataFrame) -> DataFrame:
    """An index out of the files themselves: path, session_id (the file's name), agent, first_prompt, branch; files whose first line names no session are left out."""
    heads = lines.filter("line_no = 1").withColumn("v", F.try_parse_json("line"))
    meta = F.coalesce(F.try_variant_get("v", "$.payload", "variant"), F.col("v"))
    has = lambda p: F.try_variant_get("v", p, "variant").isNotNull()
    agent = (
        F.when(get("v", "$._cursor_meta.agent_type") == "cursor", "cursor")
        .when(get("v", "$.type") == "opencode_session_meta", "opencode")
        .when(has("$.sessionId") & has("$.projectHash") & ~has("$.type"), "gemini_cli")
        .when(get(meta, "$.id").isNotNull(), "codex_cli")
    )
    own = F.when(agent == "opencode", F.coalesce(F.nullif(get("v", "$.first_prompt"), F.lit("")), get("v", "$.title"), F.lit("")))
    named = heads.select("path", agent.alias("agent"), own.alias("_own"), get(meta, "$.git.branch").alias("branch")).filter("agent IS NOT NULL")
    joined = named.join(first_prompts(lines), "path")
    name = F.regexp_replace(T.basename("path"), r"\.jsonl?$", "")
    return joined.select("path", name.alias("session_id"), "agent", T.truncate(F.coalesce("_own", "first_prompt"), PROMPT).alias("first_prompt"), "branch")


def indexed(index: DataFrame, built: DataFrame) -> DataFrame:
    """Entries of index files, and built ones for sessions that no index file names (by session_id)."""
    rest = built.join(index.select("session_id"), "session_id", "left_anti")
    return index.select("session_id", "first_prompt", "branch").unionByName(rest.select("session_id", "first_prompt", "branch"))


def sidecar(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Metadata of two places under one key, value by value: the first place's unless it has none. Both have the same columns."""
    rest = [c for c in first.columns if c not in key]
    other = second.select(*key, *[F.col(c).alias(f"_{c}") for c in rest])
    return first.join(other, key, "full").select(*key, *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in rest])


def collected(heads: DataFrame, remote: str | None = None, since: Column | None = None, depth: int = 6) -> DataFrame:
    """Session files of a repository. heads: path, mtime, line (the first one), root (the folder searched). Adds session_id, remote and bucket.

    Files deeper than depth below their root, older than since, or of another remote drop out; of files that name the same session the
    newest stays; the bucket is a slug of the remote and the beginning of its hash.
    """
    v = F.try_parse_json("line")
    meta = F.coalesce(F.try_variant_get(v, "$.payload", "variant"), v)
    below = F.size(F.split(F.replace("path", F.concat("root", F.lit("/")), F.lit("")), "/"))
    rows = heads.withColumn("session_id", F.coalesce(get(meta, "$.id"), get(v, "$.sessionId"))).withColumn("remote", T.normal_remote(get(meta, "$.git.repository_url")))
    rows = rows.filter((below <= depth) & F.col("session_id").isNotNull())
    if remote is not None:
        rows = rows.filter(F.col("remote") == remote)
    if since is not None:
        rows = rows.filter(F.col("mtime") >= since)
    newest = Window.partitionBy("session_id").orderBy(F.desc("mtime"), "path")
    rows = rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    slug = F.regexp_replace(F.coalesce("remote", F.lit("unknown")), "[^A-Za-z0-9]+", "-")
    return rows.withColumn("bucket", F.concat(slug, F.lit("-"), F.left(F.md5(F.coalesce("remote", F.lit(""))), F.lit(6))))


def opencode_sessions(session: DataFrame, message: DataFrame, part: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Tables of an opencode store to lines of its dialect: path, line_no, line; one file a session.

    session: id, parent_id, title, time_created; message: id, session_id, data, time_created; part: message_id, data, time_created (data as JSON text).
    Sessions without a parent come first; a child is written only if its parent was. Messages stand in order of time with their parts inside.
    """
    top = session.filter("parent_id IS NULL")
    if since_ms is not None:
        top = top.filter(F.col("time_created") >= since_ms)
    kids = session.filter("parent_id IS NOT NULL").join(top.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    chosen = top.unionByName(kids)
    item = F.struct(F.col("time_created").alias("t"), F.col("data").alias("p"))
    parts = part.groupBy(F.col("message_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("parts"))
    rows = message.withColumnRenamed("session_id", "_s").join(chosen.select(F.col("id").alias("_s")), "_s", "left_semi").join(parts, "id", "left")
    listed = F.array_join(F.transform(F.coalesce("parts", F.expr("cast(array() as array<struct<t:bigint,p:string>>)")), lambda x: F.concat(F.lit('{"t":'), x["t"].cast("string"), F.lit(',"p":'), x["p"], F.lit("}"))), ",")
    line = F.concat(F.lit('{"type":"opencode_message","message":'), F.col("data"), F.lit(',"parts":['), listed, F.lit("]}"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy("time_created", "id")) + 1
    said = rows.select(F.col("_s").alias("path"), place.alias("line_no"), line.alias("line"))
    return opencode_heads(chosen, message, part).unionByName(said)


def opencode_heads(chosen: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """The first line of each session: its id, parent, title and first text of a user."""
    user = message.filter(F.get_json_object("data", "$.role") == "user").select(F.col("id").alias("message_id"), "session_id", F.col("time_created").alias("m"))
    texts = part.filter(F.get_json_object("data", "$.type") == "text").select("message_id", F.col("time_created").alias("p"), F.get_json_object("data", "$.text").alias("text"))
    first = user.join(texts, "message_id").groupBy(F.col("session_id").alias("id")).agg(F.min_by("text", F.struct("m", "p", "message_id")).alias("first_prompt"))
    head = F.struct(F.lit("opencode_session_meta").alias("type"), "id", "parent_id", "title", F.left(F.coalesce("first_prompt", F.lit("")), F.lit(1000)).alias("first_prompt"))
    return chosen.join(first, "id", "left").select(F.col("id").alias("path"), F.lit(1).alias("line_no"), F.to_json(head).alias("line"))
