"""Statistics over repositories: commits (rows of lines.numstat with a subject) and files (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .aggregates import ratio

LANGUAGES = {".rb": "ruby", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java"}
TESTS, EVALS = r"(^|/)(tests?|spec|__tests__)/|_test\.|\.test\.|_spec\.", r"(^|/)evals?/"
CONVENTIONAL = r"^(feat|fix|docs|style|refactor|test|chore|perf|ci|build|revert)[(:]"
#: Language, the word with which a handler's line begins, and the classes that make it generic.
HANDLERS = {"ruby": ("rescue", ("StandardError", "Exception")), "python": ("except", ("Exception", "BaseException"))}
BRACED = ("javascript", "typescript")
FLAGS = {
    "caches": r"(?i)cache|memoiz", "batches": r"(?i)batch|in_groups|find_each", "health_check": r"(?i)/health|healthz|readiness", "logging": r"(?i)logger\.|logging\.", "monitoring": r"(?i)sentry|opentelemetry|prometheus", "feature_flags": r"(?i)feature_?flag", "retries": r"(?i)retry|backoff",
}
SQL_WORDS, SECRET_NAMES, SHELL_CALLS = ("where", "select", "execute", "query", "find_by_sql"), ("password", "passwd", "secret", "api_?key", "token"), ("exec", "system", "popen", "spawn")
#: Marks of risk: calls of eval and of a shell, texts of SQL with a value put in, names of secrets with a literal of eight characters or more.
SECURITY = {
    "eval": r"(^|[^A-Za-z0-9_])eval *\(",
    "shell": rf"(^|[^A-Za-z0-9_])({'|'.join(SHELL_CALLS)}) *\(",
    "sql_interpolation": rf"(?i)(^|[^a-z0-9_])({'|'.join(SQL_WORDS)}) *\( *f?[\"'][^\"'\n]*[#$]?\{{",
    "hardcoded_secret": rf"(?i)({'|'.join(SECRET_NAMES)})[a-z0-9_]* *[:=]+ *[\"'][^\"'\n]{{8,}}[\"']",
}


def commit_discipline(files: DataFrame) -> DataFrame:
    """files: sha, subject, date, added, deleted, file. One row of totals and ratios, and active days."""
    c = files.groupBy("sha", "subject", "date").agg(F.count("file").alias("n"), F.sum(F.col("added") + F.col("deleted")).alias("size"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    day = F.substring("date", 1, 10)
    found = c.agg(
        F.count("*").alias("commits"), F.count_if(F.rlike("subject", F.lit(CONVENTIONAL))).alias("conventional"), F.count_if(F.rlike("subject", F.lit("(?i)^revert"))).alias("reverts"), F.count_if(F.col("n") <= 20).alias("atomic"),
        F.count_if(F.rlike("subject", F.lit("(?i)refactor|clean ?up|simplif"))).alias("refactors"), F.sum("size").alias("size"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count_distinct(day).alias("active_days"),
    )
    n = F.col("commits")
    return found.select(
        "commits", ratio(F.col("conventional"), n).alias("conventional_ratio"), ratio(F.col("reverts"), n).alias("revert_ratio"), ratio(F.col("atomic"), n).alias("atomic_ratio"), F.coalesce(F.round(F.try_divide("size", n)), F.lit(0)).cast("long").alias("avg_size"),
        "added", "deleted", ratio(F.col("deleted"), F.col("added") + F.col("deleted")).alias("deletion_ratio"), ratio(F.col("refactors"), n).alias("refactor_ratio"), "active_days", ratio(n, F.col("active_days")).alias("per_active_day"),
    )


def classified(files: DataFrame) -> DataFrame:
    """files with language, kind (eval before test before prod) and loc (lines that are not blank)."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    kind = F.when(F.rlike("path", F.lit(EVALS)), "eval").when(F.rlike("path", F.lit(TESTS)), "test").otherwise("prod")
    return files.withColumn("language", F.try_element_at(names, T.extension("path"))).withColumn("kind", kind).withColumn("loc", F.regexp_count("content", F.lit(r"(?m)^.*\S.*$")))


def loc_by_class(files: DataFrame) -> DataFrame:
    return classified(files).filter("language IS NOT NULL").groupBy("language", "kind").agg(F.sum("loc").alias("loc"), F.count("*").alias("files"))


def test_quality(files: DataFrame) -> DataFrame:
    """Test to product lines, and the distinct folders of tests."""
    c = classified(files).filter("language IS NOT NULL")
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("loc")).otherwise(0))
    return c.agg(ratio(part("test"), part("prod")).alias("test_ratio"), F.sort_array(F.collect_set(F.when(F.col("kind") == "test", T.dirname("path")))).alias("test_dirs"))


def file_lengths(files: DataFrame) -> DataFrame:
    loc = F.col("loc")
    return classified(files).filter("language IS NOT NULL").agg(F.avg(loc).alias("avg"), F.median(loc).alias("median"), F.count_if(loc > 300).alias("over_300"), F.count_if(loc > 500).alias("over_500"), F.max(loc).alias("longest"))


def error_handling(files: DataFrame) -> DataFrame:
    """Handlers, specific and generic ones, by language; a handler without a class or for the broadest one is generic.

    Ruby and Python handlers are lines that begin with their word. Braced languages catch what was thrown by name: all theirs are specific.
    """
    lines = F.transform(F.split("content", "\n"), lambda x: F.ltrim(x))

    def of(word: str) -> Column:
        """The class that each handler line names, empty without one."""
        rest = lambda x: F.substring(x, F.lit(len(word) + 1), F.length(x))
        hits = F.filter(lines, lambda x: F.startswith(x, F.lit(word)) & F.rlike(F.concat(rest(x), F.lit("\n")), F.lit("^[^A-Za-z0-9_]")))
        return F.transform(hits, lambda x: F.regexp_extract(rest(x), "^[ (]*([A-Z][A-Za-z0-9_.]*(::[A-Za-z0-9_.]+)*)", 1))

    found, n_all, n_generic = classified(files).filter("content IS NOT NULL"), F.lit(0), F.lit(0)
    for language, (word, broad) in HANDLERS.items():
        mine = F.col("language") == language
        n_all = F.when(mine, F.size(of(word))).otherwise(n_all)
        named = F.array(F.lit(""), *map(F.lit, broad))
        n_generic = F.when(mine, F.size(F.filter(of(word), lambda x: F.array_contains(named, x)))).otherwise(n_generic)  # noqa: B023
    n_all = F.when(F.col("language").isin(*BRACED), F.regexp_count("content", F.lit(r"catch *\( *[A-Za-z_$][A-Za-z0-9_$]* *\)"))).otherwise(n_all)
    rows = found.filter(F.col("language").isin(*HANDLERS, *BRACED)).select("language", n_all.alias("a"), n_generic.alias("g"))
    sums = rows.groupBy("language").agg(F.sum("a").alias("handlers"), F.sum("g").alias("generic"))
    return sums.select("language", "handlers", (F.col("handlers") - F.col("generic")).alias("specific"), "generic", ratio(F.col("generic"), F.col("handlers")).alias("generic_ratio"))


def occurrences(files: DataFrame, patterns: dict[str, str] = SECURITY) -> DataFrame:
    """How often each pattern occurs in all files but tests, in one pass."""
    return classified(files).filter("kind <> 'test'").agg(*[F.coalesce(F.sum(F.regexp_count("content", F.lit(p))), F.lit(0)).alias(n) for n, p in patterns.items()])


def flags(files: DataFrame, patterns: dict[str, str] = FLAGS) -> DataFrame:
    """Whether any file holds each pattern, in one pass."""
    return files.agg(*[F.coalesce(F.bool_or(F.rlike("content", F.lit(p))), F.lit(False)).alias(n) for n, p in patterns.items()])


def component_counts(files: DataFrame, families: dict[str, dict[str, str]], framework: str) -> DataFrame:
    """Files under each of a framework's path patterns."""
    rules = [F.when(F.rlike("path", F.lit(p)), F.lit(n)) for n, p in families[framework].items()]
    return files.select(F.explode(F.array_compact(F.array(*rules))).alias("component")).groupBy("component").agg(F.count("*").alias("n"))


def config_counts(files: DataFrame, constraint: str = r"(?i)(^|[^a-z])(must|never|always|do not|don't)([^a-z]|$)") -> DataFrame:
    """Words and constraint marks of agent configuration files."""
    return files.select("path", T.word_count("content").alias("words"), F.regexp_count("content", F.lit(constraint)).alias("constraints"))


def message_counts(messages: DataFrame, by: list[str], text: str, matchers: dict[str, str]) -> DataFrame:
    """For each matcher the number of messages (not of occurrences) that hold it."""
    return messages.groupBy(*by).agg(*[F.count_if(F.rlike(text, F.lit(p))).alias(n) for n, p in matchers.items()])


def tool_summary(name: Column, input_json: Column) -> Column:
    """One line about a tool call: paths, counts and byte sizes, never the contents themselves."""
    arg = lambda k: F.coalesce(F.get_json_object(input_json, f"$.{k}"), F.lit(""))
    size = lambda c: F.octet_length(c).cast("string")
    path = F.concat(F.lit("file_path="), arg("file_path"))
    edits = F.from_json(F.get_json_object(input_json, "$.edits"), "array<struct<old_string:string,new_string:string>>")
    total = F.aggregate(edits, F.lit(0), lambda a, e: a + F.octet_length(F.coalesce(e["old_string"], F.lit(""))) + F.octet_length(F.coalesce(e["new_string"], F.lit(""))))
    body = (
        F.when(name == "Write", F.concat(path, F.lit(", content=["), size(arg("content")), F.lit(" bytes]")))
        .when(name == "Edit", F.concat(path, F.lit(", body=["), size(arg("old_string")), F.lit("]->["), size(arg("new_string")), F.lit("] bytes")))
        .when(name == "MultiEdit", F.concat(path, F.lit(", edits="), F.coalesce(F.size(edits), F.lit(0)).cast("string"), F.lit(", body=["), F.coalesce(total, F.lit(0)).cast("string"), F.lit(" bytes]")))
        .when(name == "Read", path)
        .when(name == "Bash", F.concat(F.lit("command="), F.substring_index(F.trim(arg("command")), " ", 1), F.lit(", ["), size(arg("command")), F.lit(" bytes]")))
        .when(name.isin("Grep", "Glob"), F.concat(F.lit("pattern=["), size(arg("pattern")), F.lit(" bytes]")))
        .when(name.isin("Task", "Agent"), F.concat(F.lit("description="), arg("description"), F.lit(", prompt="), T.short_hash(arg("prompt"))))
        .otherwise(F.concat(F.lit("["), size(F.coalesce(input_json, F.lit(""))), F.lit(" bytes]")))
    )
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "[Tool: <unknown>(<no input>)]").otherwise(F.concat(F.lit("[Tool: "), F.trim(name), F.lit("("), body, F.lit(")]")))


#: Words with which a stored output announces itself. Fixed values of the log format.
STORED_OPEN, STORED_CLOSE, STORED_SIZE, STORED_AT = "<persisted-output>", "</persisted-output>", "Output too large (", "tool-results/"


def between(text: Column, left: str, right: str) -> Column:
    """What stands between the first left mark and the next right one; null if either is missing."""
    at = F.locate(left, text)
    rest = F.substring(text, at + len(left), F.length(text))
    return F.when((at > 0) & F.contains(rest, F.lit(right)), F.substring_index(rest, right, 1))


def output_marker(text: Column, sizes: Column | None = None) -> Column:
    """Marker of a tool result's size: of a stored output by its file (sizes: map of file name to bytes), else by its header; null for blank results."""
    body = between(text, STORED_OPEN, STORED_CLOSE)
    file = F.split(F.concat(between(body, STORED_AT, ".txt"), F.lit(".txt")), r"\s")[0]
    known = F.lit(None).cast("string") if sizes is None else F.try_element_at(sizes, file).cast("string")
    stored = F.coalesce(F.concat(known, F.lit(" bytes")), F.concat(F.lit("~"), between(body, STORED_SIZE, ")")), F.lit("persisted"))
    size = F.when(body.isNotNull(), stored).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(" bytes")))
    return F.when(F.trim(text) != "", F.concat(F.lit("[ToolResult: "), size, F.lit("]")))


def without_stored_output(text: Column) -> Column:
    """A message without the stored outputs that it quotes: each becomes a mark of its size."""
    pieces = F.split(text, STORED_OPEN)
    note = lambda p: F.concat(F.lit("[PersistedOutput: "), F.coalesce(F.concat(F.lit("~"), between(p, STORED_SIZE, ")")), F.lit("persisted")), F.lit("]"), F.substring(p, F.locate(STORED_CLOSE, p) + len(STORED_CLOSE), F.length(p)))
    made = F.transform(pieces, lambda p, i: F.when(i == 0, p).when(F.contains(p, F.lit(STORED_CLOSE)), note(p)).otherwise(F.concat(F.lit(STORED_OPEN), p)))
    return F.when(F.contains(text, F.lit(STORED_OPEN)), F.array_join(made, "")).otherwise(text)


def with_parent_header(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks of sub-sessions with a header from their parent's prompt. chunks: session, parent_id, pos, chunk; parents: parent_id, prompt."""
    rows = chunks.join(parents.select("parent_id", "prompt"), "parent_id", "left")
    return rows.withColumn("chunk", F.when((F.col("pos") == 0) & F.col("prompt").isNotNull(), F.concat(F.lit("[Subagent task] "), F.col("prompt"), F.lit("\n\n"), F.col("chunk"))).otherwise(F.col("chunk"))).drop("prompt")


def long_enough(messages: DataFrame, by: list[str], text: str, least: int = 200) -> DataFrame:
    """Sessions whose messages hold at least so many estimated tokens."""
    return messages.groupBy(*by).agg(F.sum(T.token_estimate(text)).alias("tokens")).filter(F.col("tokens") >= least)
