"""Line-oriented sources: JSON lines, git logs, diffs and the file listings around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Line numbers of one block of a file.
BLOCK = 100_000


def read_lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """path, line_no, line, mtime of text files: one row a line, numbered inside its file from 1.

    Files are read line by line and a large file in several tasks: lines are numbered inside the block of the file that a task reads,
    and the lines of the blocks before are added. Only a row a block is ordered by file.
    """
    meta = F.col("_metadata")
    rows = spark.read.options(lineSep="\n", **options).text(path).select(
        meta["file_path"].alias("path"), meta["file_modification_time"].alias("mtime"), meta["file_block_start"].alias("_b"), F.monotonically_increasing_id().alias("_i"), F.regexp_replace("value", "\r$", "").alias("line")
    )
    blocks = rows.groupBy("path", "_b").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "_b", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(blocks, ["path", "_b"]).select("path", "mtime", (F.col("_i") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line")


def json_entries(lines: DataFrame) -> DataFrame:
    """lines with v (VARIANT): blank lines are dropped, NUL removed; a line that is no JSON object has ok = false and a null v."""
    rows = lines.withColumn("line", F.trim(T.without_nul("line"))).filter("line <> ''")
    v = F.try_parse_json("line")
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return rows.withColumn("ok", F.coalesce(is_object, F.lit(False))).withColumn("v", F.when(F.col("ok"), v))


def skipped(entries: DataFrame) -> DataFrame:
    """Lines and skipped lines by file."""
    return entries.groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("ok")).alias("n_skipped"))


def get(v: str | Column, path: str, kind: str = "string") -> Column:
    """A value inside a VARIANT; null if absent or of another kind."""
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def commits_tsv(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits of tab-separated lines (sha, short, author, email, date, subject; tabs in the subject stay), and the count of malformed lines by file."""
    parts = lines.filter("trim(line) <> ''").withColumn("p", F.split("line", "\t", 6))
    good = F.size("p") == 6
    rows = parts.filter(good).select("path", *[F.col("p")[i].alias(n) for i, n in enumerate(("sha", "short_sha", "author", "email", "date", "subject"))])
    return rows, parts.groupBy("path").agg(F.count_if(~good).alias("n_dropped"))


def numstat(lines: DataFrame, boundary: str = r"^COMMIT_BOUNDARY (\S+) (\S+) (.*) <([^>]*)>$", fields: tuple[str, ...] = ("sha", "date", "author", "email")) -> DataFrame:
    """A row for each file of each commit: the boundary's fields, added, deleted, file. Binary files count 0; lines before the first boundary are dropped."""
    is_boundary = F.rlike("line", F.lit(boundary))
    head = F.struct("line_no", *[F.regexp_extract("line", boundary, i + 1).alias(n) for i, n in enumerate(fields)])
    rows = carried(lines.withColumn("_b", is_boundary), F.when(F.col("_b"), head), "_head")
    p = F.split("line", "\t", 3)
    count = lambda i: F.coalesce(p[i].try_cast("long"), F.lit(0))
    found = rows.filter(~F.col("_b") & F.col("_head").isNotNull() & (F.size(p) == 3))
    return found.select("path", F.col("_head.line_no").alias("group_id"), *[f"_head.{n}" for n in fields], count(0).alias("added"), count(1).alias("deleted"), p[2].alias("file"))


def carried(lines: DataFrame, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """lines (path, line_no from 0 or 1) with the last value that is not null at or before each line of its file.

    Lines are dealt in blocks of so many numbers; only the last value of each block is ordered by file, so that a large file is as many
    tasks as it has blocks.
    """
    rows = lines.withColumn("_v", value).withColumn("_k", F.floor(F.col("line_no") / block))
    last = rows.filter("_v IS NOT NULL").groupBy("path", "_k").agg(F.max_by("_v", "line_no").alias("_e"))
    every = rows.select("path", "_k").distinct().join(last, ["path", "_k"], "left")
    before = Window.partitionBy("path").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ends = every.select("path", "_k", F.last("_e", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy("path", "_k").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(ends, ["path", "_k"]).withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_before")))
    return joined.drop("_v", "_k", "_before")


def git_log_piped(lines: DataFrame) -> DataFrame:
    """The second dialect: hash|date|subject lines, then numstat lines."""
    return numstat(lines, r"^([0-9a-f]{7,40})\|([^|]*)\|(.*)$", ("sha", "date", "subject"))


def commit_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("path", "sha").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.array_sort(F.collect_list("file")).alias("files"))


def across_repos(parts: dict[str, DataFrame], newest: int = 2000) -> DataFrame:
    """Commits of several repositories under repo:sha, the newest kept after all metrics are made."""
    out = None
    for repo, df in parts.items():
        named = df.withColumn("key", F.concat_ws(":", F.lit(repo), "sha"))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out.orderBy(F.desc("date"), "key").limit(newest)


def diff_stats(lines: DataFrame, tests: str = r"(^|/)(tests?|spec)/|_test\.|\.test\.|_spec\.") -> DataFrame:
    """Added, removed and added test lines of each file of a unified diff; the current file carries forward."""
    head = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1)
    rows = carried(lines, F.when(head != "", head), "file").filter("file IS NOT NULL")
    plus = F.rlike("line", F.lit(r"^\+(?!\+\+)"))
    minus = F.rlike("line", F.lit(r"^-(?!--)"))
    return rows.groupBy("path", "file").agg(F.count_if(plus).alias("added"), F.count_if(minus).alias("deleted"), F.count_if(plus & F.rlike("file", F.lit(tests))).alias("test_added"))


#: Folders whose files are not a repository's own.
VENDORED = ("node_modules", "vendor", "dist", "build", ".git")


def repo_files(spark: SparkSession, path: str, pattern: str = "*", largest: int = 100_000, most: int = 10_000) -> DataFrame:
    """path, length, content of a tree's files up to a size, without vendored folders: the first `most` by path, which is the reader's cap.

    A file counts only if its path lies below the folder that was asked for, so that links out of the tree give nothing.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    inside = F.contains("path", F.lit("/" + path.split(":")[-1].strip("/") + "/"))
    own = rows.filter((F.col("length") <= largest) & inside & ~F.arrays_overlap(parts, F.array(*map(F.lit, VENDORED))))
    return own.orderBy("path").limit(most).select("path", "length", "content")


def with_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that a foreign schema may lack, with literals in their place."""
    return df.select("*", *[c.alias(n) for n, c in defaults.items() if n not in df.columns])


def session_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """project, session_id, is_subagent and parent_id that a file's place tells: <project>/<session>.jsonl or <project>/<parent>/subagents/<id>.jsonl."""
    parts = F.split(F.col(path), "/")
    sub = F.contains(F.col(path), F.lit("/subagents/"))
    rows = files.withColumn("is_subagent", sub).withColumn("session_id", F.regexp_replace(F.element_at(parts, -1), r"\.jsonl?$", ""))
    return rows.withColumn("parent_id", F.when(sub, F.element_at(parts, -3))).withColumn("project", F.when(sub, F.element_at(parts, -4)).otherwise(F.element_at(parts, -2)))


def first_by_priority(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of several mounts, the first that has a key wins."""
    out = None
    for i, df in enumerate(parts):
        named = df.withColumn("_p", F.lit(i))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    keep = out.groupBy(*key).agg(F.min("_p").alias("_p"))
    return out.join(keep, [*key, "_p"], "left_semi").drop("_p")


def law_pages(pages: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Markdown pages (path, value: the whole text) to key (the file's name), title (first heading), category, pattern (the section of that name).

    Pages without a heading or without the section drop out; keys that categories does not name are Uncategorized.
    """
    lines = F.split("value", "\r?\n")
    title = F.try_element_at(F.filter(lines, lambda x: F.startswith(x, F.lit("# "))), F.lit(1))
    sections = F.split(F.concat(F.lit("\n"), "value"), "\n## +")
    section = F.try_element_at(F.filter(sections, lambda x: F.rlike(x, F.lit("^Pattern[ \t]*\r?\n"))), F.lit(1))
    names = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]) if categories else F.expr("cast(map() AS map<string,string>)")
    key = F.regexp_replace(T.basename("path"), r"\.md$", "")
    found = pages.select(key.alias("key"), F.trim(F.substring(title, 3, 1 << 20)).alias("title"), F.trim(F.regexp_replace(section, "^Pattern[ \t]*\r?\n", ""), F.lit(" \r\n\t")).alias("pattern"))
    rows = found.filter("title <> '' AND pattern <> ''")
    return rows.select("key", "title", F.coalesce(F.try_element_at(names, "key"), F.lit("Uncategorized")).alias("category"), "pattern")


def law_catalog(spark: SparkSession, path: str) -> DataFrame:
    """key, title, category, pattern of a catalogue kept as one JSON array."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "array<struct<key:string,title:string,category:string,pattern:string>>")).alias("x")).select("x.*")
