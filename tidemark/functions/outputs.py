"""Parsers of what test runners and git print, as small line parsers.

A summary is read clause by clause ("3 passed", "1 failure"), so that the order of the clauses and clauses in
between do not matter. The marks that tell one tool's lines from another's are the tools' own words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col

#: Runner, what its summary line begins with or holds, and the clauses it must have: the runners' own words, tried in this order.
RUNNERS = [("rspec", "", ("example", "failure")), ("jest", "Tests:", ("passed",)), ("cargo", "test result:", ("passed", "failed")), ("pytest", "", ("passed",))]


def amount(line: Column, word: str) -> Column:
    """The number in front of a word; null without one."""
    return F.regexp_extract(line, rf"([0-9]+) +{word}", 1).try_cast("int")


def lines_of(c: Column) -> Column:
    return F.split(c, "\r?\n")


def first_line(c: Column, holds) -> Column:
    """The first line for which holds(line) is true."""
    return F.try_element_at(F.filter(lines_of(c), holds), F.lit(1))


def summary_line(c: Column, mark: str, clauses: tuple[str, ...]) -> Column:
    def holds(line: Column) -> Column:
        hit = F.contains(line, F.lit(mark)) if mark else F.lit(True)
        for word in clauses:
            hit = hit & amount(line, word).isNotNull()
        return hit

    return F.when(F.contains(c, F.lit(clauses[0])), first_line(c, holds))


def test_run(c: str | Column) -> Column:
    """struct(framework, passed, failed, pending) of the first runner in order whose summary the text holds; else null.

    Examples that are not failures count as passed, pending ones among them.
    """
    c = col(c)

    def parsed(name: str, line: Column) -> Column:
        count = lambda word: F.coalesce(amount(line, word), F.lit(0))
        failed = count("failure") if name == "rspec" else count("failed")
        passed = count("example") - failed if name == "rspec" else count("passed")
        pending = count("pending") if name == "rspec" else F.lit(0)
        return F.when(line.isNotNull(), F.struct(F.lit(name).alias("framework"), passed.alias("passed"), failed.alias("failed"), pending.alias("pending")))

    return F.coalesce(*[bound(summary_line(c, mark, clauses), lambda line: parsed(name, line)) for name, mark, clauses in RUNNERS])  # noqa: B023


def bracket_words(c: Column) -> Column:
    """Words inside the brackets that begin the line in which git reports a commit, as in [main 1a2b3c4] or [main (root-commit) 1a2b3c4]."""
    inside = lambda line: F.split(F.substring_index(F.substring(F.ltrim(line), 2, 400), "]", 1), " +")
    line = first_line(c, lambda x: F.startswith(F.ltrim(x), F.lit("[")) & F.contains(x, F.lit("]")) & is_sha(F.try_element_at(inside(x), F.lit(-1))))
    return inside(line)


def is_sha(word: Column) -> Column:
    """Hexadecimal digits, seven to forty."""
    return F.length(word).between(7, 40) & (F.translate(word, "0123456789abcdef", "") == "")


def commit_sha(c: str | Column) -> Column:
    return F.try_element_at(bracket_words(col(c)), F.lit(-1))


def branch(c: str | Column) -> Column:
    """Branch that an output names: of a switch, a status or a commit, in this order. A commit on no branch names none."""
    c = col(c)
    switched = F.try_element_at(F.split(first_line(c, lambda x: F.startswith(x, F.lit("Switched to "))), "'"), F.lit(2))
    status = first_line(c, lambda x: F.startswith(x, F.lit("On branch ")))
    named = bound(bracket_words(c), lambda w: F.when(F.size(w) == 2, w[0]).when((F.size(w) == 3) & (w[1] == "(root-commit)"), w[0]))
    return F.coalesce(switched, F.trim(F.substring(status, 11, 400)), named)


def switched_branch(command: str | Column) -> Column:
    """Branch of `git checkout` or `git switch`, with or without a flag that creates it; null where another flag follows."""
    words = F.split(F.trim(col(command)), r"\s+")
    verb = F.transform(words, lambda w, i: (w == "git") & F.coalesce(F.get(words, i + 1).isin("checkout", "switch"), F.lit(False)))
    at = F.array_position(verb, F.lit(True)).cast("int")
    first, second = F.get(words, at + 1), F.get(words, at + 2)
    name = F.when(first.isin("-b", "-c"), second).otherwise(first)
    return F.when((at > 0) & ~F.startswith(name, F.lit("-")), name)


def commit_message(command: str | Column) -> Column:
    """Message of a commit command: in double quotes, in single quotes or in a here-document, in this order.

    Quotes count from the first -m; a backslash keeps a double quote inside.
    """
    command = col(command)
    rest = F.when(F.contains(command, F.lit("-m ")), F.ltrim(F.substring(command, F.locate("-m ", command) + 3, F.length(command))))
    body = F.substring(rest, F.lit(2), F.length(rest))
    double = F.split(body, r'(?<!\\)"')
    single = F.split(body, "'")
    quoted = F.when(F.startswith(rest, F.lit('"')) & (F.size(double) > 1), double[0]).when(F.startswith(rest, F.lit("'")) & (F.size(single) > 1), single[0])
    return F.coalesce(quoted, here_document(command))


def here_document(command: Column) -> Column:
    """The lines between the first <<WORD and the line that is WORD alone."""
    lines = lines_of(command)
    marks = F.transform(lines, lambda x: F.regexp_extract(x, "<<-? *['\"]?([A-Za-z_]+)", 1))
    opens = F.array_position(F.transform(marks, lambda m: m != ""), F.lit(True)).cast("int")
    word = F.get(marks, opens - 1)
    below = F.slice(lines, F.greatest(opens + 1, F.lit(1)), F.size(lines))
    closes = F.array_position(F.transform(below, lambda x: F.trim(x) == word), F.lit(True)).cast("int")
    return F.when((opens > 0) & (closes > 0), F.trim(F.array_join(F.slice(below, F.lit(1), F.greatest(closes - 1, F.lit(0))), "\n")))


def diffstat(c: str | Column) -> Column:
    """struct(files, insertions, deletions) of the line in which git counts changes; null without one."""
    line = first_line(col(c), lambda x: F.contains(x, F.lit(" changed")) & amount(x, "file").isNotNull())
    count = lambda word: F.coalesce(amount(line, word), F.lit(0))
    return F.when(line.isNotNull(), F.struct(count("file").alias("files"), count("insertion").alias("insertions"), count("deletion").alias("deletions")))


def error_line(c: str | Column) -> Column:
    """The first line that states an error: a word that ends in error, exception, failed or errno with a colon, mark or space behind it."""
    line = first_line(col(c), lambda x: F.rlike(F.lower(x), F.lit("(error|exception|failed|errno)[:! ]")))
    return F.nullif(F.trim(line), F.lit(""))
