"""Scalar functions, classifiers, parsers of tool output and JSON repair, over texts that are made from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import jsonrepair as J
from ..functions import outputs as O
from ..functions import redact as R
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import codebase as K
from ..session import table
from .registry import query


def pick(values: list[str], key: Column) -> Column:
    """The value at key modulo their number."""
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_pick(values: list[str], key: str) -> str:
    return f"list_value({', '.join(map(quoted, values))})[({key}) % {len(values)} + 1]"


PATHS = ["src/app/main.py", "/abs/x.tar.gz", "name", ".hidden", "dir/", "a.b/c", "/top", "w-x_y.z"]


@query(
    f"""WITH x AS (SELECT p_partkey, {sql_pick(PATHS, 'p_partkey')} AS path, {sql_pick(['read_file', 'run-shell-command', 'task', ''], 'p_partkey')} AS tool FROM part),
y AS (SELECT *, regexp_replace(path, '/+$', '') AS p FROM x)
SELECT p_partkey, list_last(string_split(p, '/')) AS base, CASE WHEN NOT contains(path, '/') THEN '.' WHEN NOT contains(p, '/') THEN '/' WHEN regexp_matches(p, '^/[^/]*$') THEN '/' ELSE regexp_extract(p, '^(.*)/[^/]*$', 1) END AS folder,
  regexp_extract(list_last(string_split(p, '/')), '^.+(\\.[^.]*[^.])$', 1) AS ending, CASE WHEN list_last(string_split(path, '/')) = '' THEN path ELSE list_last(string_split(path, '/')) END AS shown,
  CASE tool WHEN 'read_file' THEN 'ReadFile' WHEN 'run-shell-command' THEN 'RunShellCommand' WHEN 'task' THEN 'Task' ELSE '' END AS tool FROM y"""
)
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    """Parts of paths, display names and names of tools."""
    path, key = pick(PATHS, F.col("p_partkey")), F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", path.alias("path"), pick(["read_file", "run-shell-command", "task", ""], key).alias("tool"))
    return rows.select("p_partkey", T.basename("path").alias("base"), T.dirname("path").alias("folder"), T.extension("path").alias("ending"), T.last_part("path").alias("shown"), T.pascal("tool").alias("tool"))


@query(
    """WITH x AS (SELECT p_partkey, p_name || chr(9) || chr(7) || '  ' || p_type || chr(10) || repeat('z', p_size) AS raw, p_partkey || ' – ' || p_size || ' — ' || p_name AS dashed, 'A ' || p_name || ' is Small, small and SMALL; ringside' AS said FROM part)
SELECT p_partkey, CASE WHEN length(c) > 50 THEN left(c, 47) || '...' ELSE c END AS shown, regexp_replace(regexp_replace(dashed, '([0-9])\\s*[–—]\\s*([0-9])', '\\1-\\2', 'g'), '\\s*[–—]\\s*', ', ', 'g') AS dashes, words, hits
FROM (SELECT *, trim(regexp_replace(regexp_replace(raw, '[\\x00-\\x1F\\x7F]', ' ', 'g'), ' +', ' ', 'g')) AS c, replace(replace(replace(said, 'SMALL', 'TINY'), 'Small', 'Tiny'), 'small', 'tiny') AS words,
  (contains(p, ' ring') AND regexp_matches(p, '(^|[^a-z])ring([^a-z]|$)'))::INT + regexp_matches(p, '(^|[^a-z])red([^a-z]|$)')::INT AS hits FROM (SELECT *, lower(said) AS p FROM x))"""
)
def display_functions(spark: SparkSession, d: str) -> DataFrame:
    """Texts for display, dashes, words replaced in their form, lexicon hits."""
    p, n = table(spark, d, "part"), F.col("p_partkey").cast("string")
    raw = F.concat(F.col("p_name"), F.lit("\t\x07  "), F.col("p_type"), F.lit("\n"), F.expr("repeat('z', p_size)"))
    dashed = F.concat(n, F.lit(" – "), F.col("p_size").cast("string"), F.lit(" — "), F.col("p_name"))
    said = F.concat(F.lit("A "), F.col("p_name"), F.lit(" is Small, small and SMALL; ringside"))
    hits = F.size(T.lexicon_hits(said, {"ring": "thing", "red": "colour"}))
    return p.select("p_partkey", T.clean_display(raw, 50).alias("shown"), T.plain_dashes(dashed).alias("dashes"), T.replace_words(said, {"small": "tiny"}).alias("words"), hits.alias("hits"))


NUMBERS = ["7.5", " 12 ", "-3", "1e3", "7.5 points", "", "+0.25", "ten"]


@query(
    f"""WITH x AS (SELECT o_orderkey, {sql_pick(NUMBERS, 'o_orderkey')} AS said, o_custkey AS n, o_orderkey % 4 AS m FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(said, '^\\s*[+-]?[0-9]+(\\.[0-9]+)?\\s*$') THEN trim(said)::DOUBLE END AS number, least(greatest(n, 10), 500) AS clamped, CASE WHEN m = 0 THEN 0 ELSE (2000 * n + m) // (2 * m) END::BIGINT AS ratio_permille,
  greatest(CASE WHEN n <= 30 THEN (30 + 3 * n + 59) // 60 WHEN n <= 200 THEN (120 + n - 30 + 59) // 60 ELSE (290 + n - 200 + 59) // 60 END, 2)::BIGINT AS minutes, CASE WHEN o_orderkey % 3 = 0 THEN 7.0 ELSE least(pow(2.0, o_orderkey % 9), 60.0) END AS backoff FROM x"""
)
def number_functions(spark: SparkSession, d: str) -> DataFrame:
    """Numbers out of texts, clamping, null-safe ratios, time estimates and back-off."""
    key, n = F.col("o_orderkey"), F.col("o_custkey")
    ratio = (A.ratio(n, key % 4) * 1000).cast("long")
    wait = F.when(key % 3 == 0, 7.0)
    return table(spark, d, "orders").select("o_orderkey", T.number_or_null(pick(NUMBERS, key)).alias("number"), T.clamp(n, 10, 500).cast("long").alias("clamped"), ratio.alias("ratio_permille"), T.minutes_estimate(n).cast("long").alias("minutes"), T.backoff_seconds(key % 9, wait).alias("backoff"))


SPANS, OFFSETS = ["6h", "7d", "2w", "1m", "5", "h3"], ["+05:30", "-0800", "Z", "+00:00", "-03:15", ""]


@query(
    f"""WITH x AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, {sql_pick(SPANS, 'event_id')} AS span, {sql_pick(OFFSETS, 'event_id')} AS off FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed, strftime(make_timestamp(event_id * 86400123000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS from_ms,
  CASE span WHEN '6h' THEN 21600 WHEN '7d' THEN 604800 WHEN '2w' THEN 1209600 WHEN '1m' THEN 2592000 END::BIGINT AS seconds, CASE off WHEN '+05:30' THEN 330 WHEN '-0800' THEN -480 WHEN '+00:00' THEN 0 WHEN '-03:15' THEN -195 END AS minutes,
  CASE off WHEN '+05:30' THEN '+05:30' WHEN '-0800' THEN '-08:00' WHEN '+00:00' THEN '+00:00' WHEN '-03:15' THEN '-03:15' END AS shown, strftime(ts, '%Y-%m-%d') AS day FROM x"""
)
def time_functions(spark: SparkSession, d: str) -> DataFrame:
    """Lenient times, milliseconds to ISO, durations, offsets from UTC and days as written."""
    key, iso = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(key % 5 == 0, F.concat(F.lit("x"), iso)).otherwise(iso)
    minutes = T.utc_offset_minutes(F.concat(iso, pick(OFFSETS, key)))
    minutes = F.when(pick(OFFSETS, key).isin("Z", ""), F.lit(None)).otherwise(minutes)
    return table(spark, d, "events").select("event_id", F.date_format(T.lenient_ts(said), "yyyy-MM-dd HH:mm:ss").alias("parsed"), T.ms_to_iso(key * 86_400_123).alias("from_ms"), T.duration_seconds(pick(SPANS, key)).alias("seconds"), minutes.alias("minutes"), T.offset_text(minutes).alias("shown"), T.date_part(iso).alias("day"))


@query(
    """SELECT p_partkey, lower(p_name) AS last_tag, 'plain ' || p_type || ' end' AS stripped, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END || CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN chr(10) || chr(10) ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS document,
  p_name || '/' || p_type AS clean, CASE WHEN p_size > 25 THEN 'a=' || p_size || ',' ELSE 'a=7,' END || 'b=' || p_partkey AS merged, 'a=7' AS sliced FROM part"""
)
def document_functions(spark: SparkSession, d: str) -> DataFrame:
    """Tags, sections that vanish, NUL inside nested values, and maps merged, compacted and sliced."""
    p, key = table(spark, d, "part"), F.col("p_partkey")
    tagged = F.concat(F.lit("<Tone>x</Tone> y <tone>\n "), F.upper("p_name"), F.lit(" </tone>"))
    marked = F.concat(F.lit("plain <note>a\nb</note>"), F.col("p_type"), F.lit(" end<NOTE></NOTE>"))
    parts = T.sections(F.when(key % 3 == 0, F.col("p_brand")), F.when(key % 2 == 0, F.col("p_type")))
    rows = p.withColumn("inside", F.struct(F.concat(F.lit("\0"), "p_name").alias("a"), F.array(F.concat("p_type", F.lit("\0\0"))).alias("b"), F.create_map(F.lit("k"), F.lit("\0")).alias("c"), F.lit(1).alias("n")))
    clean = T.without_nul_inside(F.col("inside"), rows.schema["inside"].dataType)
    left = F.create_map(F.lit("a"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")))
    right = F.create_map(F.lit("a"), F.lit("7"), F.lit("b"), key.cast("string"), F.lit("c"), F.lit(None).cast("string"))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return rows.select(
        "p_partkey", T.last_tag(tagged, "tone").alias("last_tag"), T.without_tag(marked, "note").alias("stripped"), parts.alias("document"),
        F.concat_ws("/", clean["a"], F.concat(clean["b"][0], clean["c"]["k"])).alias("clean"), shown(T.map_compact(T.map_merge(left, right))).alias("merged"), shown(T.map_slice(right, ["a", "z"])).alias("sliced"),
    )


PROMPTS = ["Add a ring", "why is it so", "That is wrong, redo", "the build fails today", "please review this", "hm", "could you see", "Is it ready?"]
PROMPT_TYPES = ["directive", "question", "correction", "debugging", "review", "other", "question", "question"]


@query(f"SELECT {sql_pick(PROMPT_TYPES, 'p_partkey')} AS prompt_type, count(*) AS n FROM part GROUP BY 1")
def prompt_types(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of prompts by six ordered rules."""
    return table(spark, d, "part").groupBy(C.prompt_type(pick(PROMPTS, F.col("p_partkey"))).alias("prompt_type")).agg(F.count("*").alias("n"))


SUBJECTS = ["feat(ui): x", "fix!: y", "Refactor: z", "test: a", "docs(api): b", "chore: c", "wip", "feature: no"]
SUBJECT_TYPES = ["feat", "fix", "refactor", "test", "docs", "chore", "other", "other"]


@query(f"SELECT {sql_pick(SUBJECT_TYPES, 'o_orderkey')} AS commit_type, count(*) AS n FROM orders GROUP BY 1")
def commit_types(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of conventional commit prefixes."""
    return table(spark, d, "orders").groupBy(C.commit_type(pick(SUBJECTS, F.col("o_orderkey"))).alias("commit_type")).agg(F.count("*").alias("n"))


SAID = ["use the login token", "a schema for the table", "mock the spec", "the button layout", "too slow, add a cache", "deploy the server", "nothing of note", "drop the old table, rename it"]
DOMAINS = ["security", "data", "testing", "interface", "performance", "infrastructure", "general", "data"]
REVERSE = ["reversible", "reversible", "reversible", "reversible", "reversible", "reversible", "reversible", "irreversible"]
STEERED = {"redirect": "use this instead, rather than that", "stop": "wait, stop here", "approve": "yes, great", "reject": "no, undo it", "ask": "is it done?", "scope": "only the first, skip all else"}
ERRORS = {"rate_limit": "HTTP 429 too many requests", "timeout": "the call timed out", "parse": "unexpected token <", "auth": "403 forbidden", "network": "connection refused", "other": "boom"}


@query(
    f"""SELECT p_partkey, {sql_pick(DOMAINS, 'p_partkey')} AS domain, {sql_pick(REVERSE, 'p_partkey')} AS reversibility, {sql_pick(list(STEERED), 'p_partkey')} AS steering, {sql_pick(list(ERRORS), 'p_partkey')} AS error_class,
  list_value('high', 'high', 'medium', 'low')[(p_partkey % 4) + 1] AS by_decision, list_value('medium', 'high', 'high')[(p_partkey % 3) + 1] AS escalated FROM part"""
)
def decision_rules(spark: SparkSession, d: str) -> DataFrame:
    """Domain, reversibility, steering, error class and significance by the library's own rules."""
    key = F.col("p_partkey")
    kinds = pick(["strategic_redirect", "product_insight", "technical_catch", "option_selection"], key)
    steering = C.all_of(pick(list(STEERED.values()), key), C.STEERING)[0]
    return table(spark, d, "part").select("p_partkey", C.domain(pick(SAID, key)).alias("domain"), C.reversibility(pick(SAID, key)).alias("reversibility"), steering.alias("steering"), C.error_class(pick(list(ERRORS.values()), key)).alias("error_class"), C.significance_of_decision(kinds).alias("by_decision"), C.escalated(pick(["low", "medium", "high"], key)).alias("escalated"))


@query("SELECT p_partkey, CASE WHEN p_size >= 40 OR (p_partkey % 2 = 0 AND p_partkey % 3 = 0) THEN 'high' WHEN p_size >= 12 OR p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 'medium' ELSE 'low' END AS significance FROM part")
def significance(spark: SparkSession, d: str) -> DataFrame:
    """Significance by the length of an answer, its domain and its reasons."""
    key = F.col("p_partkey")
    words = F.expr("trim(repeat('word ', greatest(p_size, 1) - CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END))")
    said = F.when(key % 3 == 0, F.concat(words, F.lit(" because"))).otherwise(words)
    return table(spark, d, "part").select("p_partkey", C.significance(F.lit("x"), said, F.when(key % 2 == 0, "security").otherwise("interface")).alias("significance"))


PROPOSALS = ["Option 1 or Option 2?\n- a\n- b\n- c", "There are several ways to do it", "We could:\n1. **Add** x\n2. **Drop** y", "Would you like me to go on?", "The trade-off is clear", "Done as told.", "Approach A, approach B, variant 3", "Shall I proceed"]
PROPOSAL_TYPES = ["options", "options", "options", "question", "options", None, "options", "question"]
COUNTS = [3, None, 2, None, None, None, 3, None]
ANSWERS = ["option 2 please with the large ring", "rather build something other entirely new", "the second one", "go"]


@query(
    f"""SELECT p_partkey, list_value({', '.join('NULL' if x is None else quoted(x) for x in PROPOSAL_TYPES)})[p_partkey % 8 + 1] AS proposal_type, list_value({', '.join('NULL' if x is None else str(x) for x in COUNTS)})[p_partkey % 8 + 1] AS option_count,
  p_partkey % 4 = 1 AND list_value({', '.join('NULL' if x is None else quoted(x) for x in PROPOSAL_TYPES)})[(p_partkey // 4) % 8 + 1] IS NOT DISTINCT FROM 'options' AS counter FROM part"""
)
def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals by kind, the number of options, and answers that bring a proposal of their own."""
    key = F.col("p_partkey")
    counter = C.counter_proposal(pick(ANSWERS, key), pick(PROPOSALS, F.floor(key / 4)))
    return table(spark, d, "part").select("p_partkey", C.proposal_type(pick(PROPOSALS, key)).alias("proposal_type"), C.option_count(pick(PROPOSALS, key)).cast("int").alias("option_count"), F.coalesce(counter, F.lit(False)).alias("counter"))


HEATED = ["fine!", "what!!", "NEVER EVER do", "JSON API README", "ugh, again", "calm words", "", "STOP that"]


@query("SELECT p_partkey FROM part WHERE p_partkey % 8 IN (1, 2, 4) AND p_size <= 28")
def heated_messages(spark: SparkSession, d: str) -> DataFrame:
    """Heated messages; long ones do not count."""
    said = F.concat(pick(HEATED, F.col("p_partkey")), F.when(F.col("p_size") > 28, F.lit(" word" * 60)).otherwise(""))
    return table(spark, d, "part").filter(C.charged(said)).select("p_partkey")


COMMANDS = ["codex exec x", "cd /w && /usr/bin/gemini -p 'y'", "echo codex", "A=1 opencode run --cwd /a", "nohup codex --cd '/a b' &", "ls -C /x", "git codex", "codex -C /x y"]


@query("SELECT p_partkey, p_partkey % 8 IN (0, 1, 3, 4, 7) AS launches, CASE p_partkey % 8 WHEN 3 THEN '/a' WHEN 4 THEN '/a b' WHEN 5 THEN '/x' WHEN 7 THEN '/x' END AS cwd FROM part")
def launch_commands(spark: SparkSession, d: str) -> DataFrame:
    """Commands that start an agent at a command's place, and the folder they name."""
    said = pick(COMMANDS, F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", C.launch_command(said).alias("launches"), C.launch_cwd(said).alias("cwd"))


@query(
    """SELECT o_orderkey, lower(hex(o_orderkey + 268435456)) AS sha, CASE o_orderkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'dev/x' END AS branch, CASE WHEN o_orderkey % 4 < 3 THEN 'told ' || o_custkey ELSE NULL END AS message,
  (o_orderkey % 9 + 1)::INT AS files, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END::INT AS insertions, (o_orderkey % 5)::INT AS deletions, CASE o_orderkey % 3 WHEN 0 THEN 'topic' WHEN 1 THEN 'b2' END AS switched FROM orders"""
)
def git_outputs(spark: SparkSession, d: str) -> DataFrame:
    """What git prints and is told: commits, branches, messages in three kinds of quotes, counts of changes."""
    key, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    sha = F.lower(F.hex(key + 268435456))
    head = pick(["main (root-commit)", "dev/x", "detached HEAD"], key)
    printed = F.concat(F.lit("note [x]\n["), head, F.lit(" "), sha, F.lit("] told\n 1 file"))
    told = F.concat(F.lit("told "), n)
    command = F.when(key % 4 == 0, F.concat(F.lit('git commit -m "'), told, F.lit('"'))).when(key % 4 == 1, F.concat(F.lit("git commit -m '"), told, F.lit("'"))).when(key % 4 == 2, F.concat(F.lit("git commit -F - <<'EOF'\n"), told, F.lit("\nEOF"))).otherwise("git commit")
    stat = F.concat(F.lit(" "), (key % 9 + 1).cast("string"), F.lit(" files changed"), F.when(key % 2 == 0, F.concat(F.lit(", "), n, F.lit(" insertions(+)"))).otherwise(""), F.when(key % 5 > 0, F.concat(F.lit(", "), (key % 5).cast("string"), F.lit(" deletions(-)"))).otherwise(""))
    change = O.diffstat(stat)
    switch = O.switched_branch(pick(["git checkout -b topic", "cd x && git switch b2", "git checkout -- x"], key))
    return table(spark, d, "orders").select("o_orderkey", O.commit_sha(printed).alias("sha"), O.branch(printed).alias("branch"), O.commit_message(command).alias("message"), change["files"].alias("files"), change["insertions"].alias("insertions"), change["deletions"].alias("deletions"), switch.alias("switched"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE '{"k": ' || json_extract_string(props, '$.k') || '}' END AS object, CASE event_id % 4 WHEN 3 THEN NULL ELSE '[{"k": ' || json_extract_string(props, '$.k') || '}]' END AS list,
  least(greatest(json_extract_string(props, '$.k')::DOUBLE, 0), 10) AS score, 5.0::DOUBLE AS missing FROM events"""
)
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Objects and arrays out of fenced and broken texts, and scores that are clamped."""
    key, props = F.col("event_id"), F.col("props")
    said = F.when(key % 4 == 0, props).when(key % 4 == 1, F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\nbye {"))).when(key % 4 == 2, F.concat(F.lit('see {not json} "}" '), props, F.lit(" and {x"))).otherwise("nothing {here")
    scores = J.scores(props, ["k", "z"])
    return table(spark, d, "events").select("event_id", J.json_object(said).alias("object"), J.json_array(said).alias("list"), scores["k"].alias("score"), scores["z"].alias("missing"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '[Tool: Write(file_path=a, content=[' || strlen(p_name) || ' bytes])]' WHEN 1 THEN '[Tool: Bash(command=ls, [' || (strlen(p_name) + 3) || ' bytes])]' WHEN 2 THEN '[Tool: Read(file_path=' || p_name || ')]'
  WHEN 3 THEN '[Tool: Grep(pattern=[' || strlen(p_name) || ' bytes])]' ELSE '[Tool: <unknown>(<no input>)]' END AS summary, CASE p_partkey % 3 WHEN 0 THEN '[ToolResult: ' || strlen(p_name) || ' bytes]' WHEN 1 THEN '[ToolResult: ~' || p_size || 'KB]' END AS marker,
  'see [PersistedOutput: ~' || p_size || 'KB] there' AS quoted FROM part"""
)
def tool_summaries(spark: SparkSession, d: str) -> DataFrame:
    """One line about tool calls and results: sizes, never contents."""
    key, name = F.col("p_partkey"), F.col("p_name")
    args = F.when(key % 5 == 0, F.to_json(F.struct(F.lit("a").alias("file_path"), name.alias("content")))).when(key % 5 == 1, F.to_json(F.struct(F.concat(F.lit("ls "), name).alias("command")))).when(key % 5 == 2, F.to_json(F.struct(name.alias("file_path")))).otherwise(F.to_json(F.struct(name.alias("pattern"))))
    stored = F.concat(F.lit("<persisted-output>Output too large ("), F.col("p_size").cast("string"), F.lit("KB) saved to: /x/tool-results/a.txt</persisted-output>"))
    result = F.when(key % 3 == 0, name).when(key % 3 == 1, stored).otherwise("  ")
    quoted_in = F.concat(F.lit("see "), stored, F.lit(" there"))
    return table(spark, d, "part").select("p_partkey", K.tool_summary(pick(["Write", "Bash", "Read", "Grep", " "], key), args).alias("summary"), K.output_marker(result).alias("marker"), K.without_stored_output(quoted_in).alias("quoted"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'see [py code, ~' || (p_size + 1) || ' lines] ok' WHEN 1 THEN 'use [identifier] of ' || p_name || ' and `plain`' WHEN 2 THEN '[code line]' || chr(10) || p_name ELSE 'in [path], then [path]' END AS redacted FROM part"""
)
def code_notes(spark: SparkSession, d: str) -> DataFrame:
    """Code blocks, identifiers, indented statements and paths as notes."""
    key, name = F.col("p_partkey"), F.col("p_name")
    block = F.concat(F.lit("see ```py\n"), F.expr("repeat('x\n', p_size)"), F.lit("y\n``` ok"))
    said = F.when(key % 4 == 0, block).when(key % 4 == 1, F.concat(F.lit("use `a_b` of "), name, F.lit(" and `plain`"))).when(key % 4 == 2, F.concat(F.lit("    return "), name, F.lit("\n"), name)).otherwise(F.concat(F.lit("in /usr/lib/"), F.replace(name, F.lit(" "), F.lit("_")), F.lit(", then src/a.py")))
    return table(spark, d, "part").select("p_partkey", R.code_redact(said).alias("redacted"))


RATES = [("large", 15, 75), ("mid", 3, 15), ("m", 1, 5)]


@query(
    """WITH r AS (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS i, CASE o_orderkey % 4 WHEN 0 THEN 75 WHEN 1 THEN 15 WHEN 2 THEN 5 ELSE 0 END AS o, o_orderkey % 1000 AS n FROM orders)
SELECT o_custkey, ceil(sum(n * i + 2 * n * o) / 10000.0)::BIGINT AS cents FROM r GROUP BY 1"""
)
def model_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost by a table of rates; the first name that a model's name holds sets the price."""
    key = F.col("o_orderkey")
    rate = A.rate_of(pick(["x-Large-m", "a-mid-1", "some-m", "zzz"], key), RATES)
    rows = table(spark, d, "orders").select("o_custkey", (key % 1000 * rate["input"] + 2 * (key % 1000) * rate["output"]).alias("product"))
    return rows.groupBy("o_custkey").agg(A.cost_cents(F.sum("product"), F.lit(1)).alias("cents"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'counter_proposal' WHEN 1 THEN 'redirect' WHEN 2 THEN 'option_selection' ELSE 'approval' END AS kind, CASE p_partkey % 4 WHEN 1 THEN 'data' ELSE 'general' END AS domain,
  CASE p_partkey % 4 WHEN 1 THEN 'medium' ELSE 'low' END AS significance, CASE p_partkey % 4 WHEN 1 THEN 'irreversible' ELSE 'reversible' END AS reversibility FROM part"""
)
def fallback_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges classified by rules alone, as when no model answers."""
    key = F.col("p_partkey")
    proposal = pick(["Option 1 or option 2", "Shall I go on", "Option A or option B", "Done"], key)
    response = pick(["write something other entirely fresh", "no, drop the table", "option B", "fine"], key)
    return table(spark, d, "part").select("p_partkey", C.fallback_decision(proposal, response).alias("x")).select("p_partkey", "x.*")
