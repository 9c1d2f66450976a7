"""Redaction by ordered patterns. Order is semantic: addresses with a user part go before e-mail addresses, blocks before single marks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, truncate

#: (pattern, replacement), applied in this order.
SECRETS = [
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", "[key]"),
    ("AKIA[0-9A-Z]{16}", "[access-key]"),
    ("gh[pousr]_[A-Za-z0-9]{20,}", "[token]"),
    ("sk-[A-Za-z0-9_-]{20,}", "[token]"),
    ("eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", "[jwt]"),
    ("([a-z][a-z0-9+.-]*://)[^/@ \n\t:]+:[^/@ \n\t]+@", "$1[login]@"),
    ("(git@|ssh://)[A-Za-z0-9.-]+[:/][A-Za-z0-9._/-]+", "[remote]"),
    ("((password|passwd|secret|api_key|token) ?[=:] ?)[^ \n\t,;]+", "$1[secret]"),
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[email]"),
    ("[+][0-9][0-9 ()-]{8,}[0-9]", "[phone]"),
    ("(/Users/|/home/)[A-Za-z0-9._-]+", "$1[user]"),
]

#: For each pattern the strings of which a text must hold one for it to match at all.
MARKS = [("-----BEGIN",), ("AKIA",), ("gh",), ("sk-",), ("eyJ",), ("://",), ("git@", "ssh://"), ("password", "passwd", "secret", "api_key", "token"), ("@",), ("+",), ("/Users/", "/home/")]

#: First words of statements in common languages.
STATEMENT_WORDS = (
    "async", "await", "begin", "case", "catch", "class", "const", "def", "do", "elif", "else", "end", "enum", "except", "export", "finally", "fn", "for", "from", "func", "function",
    "if", "impl", "import", "interface", "let", "match", "package", "pass", "private", "public", "raise", "return", "static", "struct", "switch", "throw", "try", "type", "use", "var", "while", "with", "yield",
)
#: Endings that make a relative name a path.
FILE_ENDINGS = ("c", "cfg", "cpp", "css", "go", "h", "html", "ini", "java", "js", "json", "jsx", "kt", "md", "py", "rb", "rs", "sh", "sql", "swift", "toml", "ts", "tsx", "txt", "xml", "yaml", "yml")
LONG_SPAN = 10


def scrub(c: str | Column) -> Column:
    """Secrets and personal data out. A pattern runs only on texts that hold a mark without which it cannot match."""
    out = col(c)
    for (pattern, to), marks in zip(SECRETS, MARKS, strict=True):
        out = bound(out, lambda x: F.when(reduce(or_, (F.contains(x, F.lit(m)) for m in marks)), F.regexp_replace(x, pattern, to)).otherwise(x))  # noqa: B023
    return out


def code_like(span: Column) -> Column:
    """Whether what stands between two backticks is code: capitals, digits, underscores or punctuation in it, or one long word."""
    marked = F.translate(span, "abcdefghijklmnopqrstuvwxyz -'", "") != ""
    return marked | ((F.length(span) >= LONG_SPAN) & ~F.contains(span, F.lit(" ")))


def without_spans(line: Column) -> Column:
    """A line with its code-like spans as [identifier]; pieces between backticks alternate between prose and spans."""
    pieces = F.split(line, "`")
    last = F.size(pieces) - 1
    closed = F.when(last % 2 == 0, last).otherwise(last - 1)  # an odd backtick at the end opens nothing
    written = F.transform(
        pieces,
        lambda p, i: F.when(i == 0, p).when((i % 2 == 1) & (i < closed), F.when(code_like(p), "[identifier]").otherwise(F.concat(F.lit("`"), p, F.lit("`")))).when((i % 2 == 1) | (i > closed), F.concat(F.lit("`"), p)).otherwise(p),
    )
    return F.array_join(written, "")


def code_line(line: Column) -> Column:
    """Whether an indented line is a statement: it begins with a statement's word or ends as one does."""
    indented = F.startswith(line, F.lit("  ")) | F.startswith(line, F.lit("\t"))
    word = F.regexp_extract(line, "^[ \t]+([a-z]+)", 1)
    tail = F.right(F.rtrim(line), F.lit(1))
    return indented & (F.trim(line) != "") & (word.isin(*STATEMENT_WORDS) | tail.isin("{", "}", ";"))


def without_paths(text: Column) -> Column:
    """Absolute paths, and relative ones whose last part has a file's ending, as [path]."""
    part = "[A-Za-z0-9_.-]+"
    begins, ends = "(?<![A-Za-z0-9_./-])", "(?![A-Za-z0-9_])"
    text = F.regexp_replace(text, f"{begins}(/{part})+/?", "[path]")
    return F.regexp_replace(text, f"{begins}({part}/)*{part}[.]({'|'.join(sorted(FILE_ENDINGS, key=len, reverse=True))}){ends}", "[path]")


def fenced(text: Column) -> Column:
    """Fenced blocks as a note of their language and number of lines: fences alternate between opening and closing."""
    pieces = F.split(text, "```")
    closed = F.size(pieces) - 1 - (F.size(pieces) - 1) % 2

    def note(block: Column) -> Column:
        lang = F.regexp_extract(block, "^([A-Za-z0-9_+-]+)", 1)
        n = F.size(F.split(block, "\n")) - 2  # without the fences' own lines
        return F.concat(F.lit("["), F.when(lang == "", "code block").otherwise(F.concat(lang, F.lit(" code"))), F.lit(", ~"), F.greatest(n, F.lit(0)).cast("string"), F.lit(" lines]"))

    written = F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & (i < closed), note(p)).when(i > closed, F.concat(F.lit("```"), p)).otherwise(p))
    return F.when(F.contains(text, F.lit("```")), F.array_join(written, "")).otherwise(text)


def code_redact(c: str | Column, cap: int = 2000) -> Column:
    """Code out of a text: fenced blocks, then indented statements, code-like spans and paths; notes that follow each other become one."""
    text = fenced(F.coalesce(col(c), F.lit("")))
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(code_line(x), "[code line]").otherwise(F.when(F.contains(x, F.lit("`")), without_spans(x)).otherwise(x)))
    out = without_paths(F.array_join(lines, "\n"))
    note = r"\[(?:code|[A-Za-z0-9_+-]+ code)[^\]\[]*\]"
    out = F.regexp_replace(out, rf"(?:{note}\s*){{2,}}", "[code] ")
    return truncate(F.trim(out), cap)
