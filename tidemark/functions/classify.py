"""Ordered classifiers: rules are tried in order, the first that holds names the class. The lexicons are the engine's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import AFTER, BEFORE, col

Rules = list[tuple[str, str]]


def word(pattern: str) -> str:
    return f"(?i){BEFORE}({pattern}){AFTER}"


DOMAINS: Rules = [
    ("security", word("auth|token|secret|permission|encrypt|login")),
    ("data", word("database|schema|migration|query|index|table")),
    ("testing", word("test|tests|spec|assert|mock|coverage")),
    ("interface", word("button|layout|page|screen|style|menu")),
    ("performance", word("slow|fast|cache|latency|memory|batch")),
    ("infrastructure", word("deploy|docker|server|pipeline|cluster|build")),
]
IMPERATIVES = ("add", "change", "create", "delete", "fix", "make", "move", "remove", "rename", "run", "update", "use", "write")
QUESTION_STARTS = ("how", "what", "why", "where", "when", "can you", "could you")
CORRECTIONS, DEBUGGING, REVIEWS = word("no|wrong|instead|not what|actually|revert"), word("error|fails|failing|broken|crash|stack trace"), word("review|check|look at|feedback")
COMMIT_PREFIXES = ("feat", "fix", "refactor", "test", "docs", "chore")
STEERING: Rules = [
    ("redirect", word("instead|rather|switch|change")),
    ("stop", word("stop|wait|hold")),
    ("approve", word("yes|ok|good|great|fine")),
    ("reject", word("no|wrong|undo|revert")),
    ("ask", r"\?\s*$"),
    ("scope", word("only|just|skip|ignore")),
]
IRREVERSIBLE, COSTLY = word("drop|delete|migrate|publish|release"), word("rename|rewrite|refactor|replace")
#: How a message offers a choice: nouns that take a label, words that count them, phrases before a list, phrases that weigh.
CHOICES = ("option", "approach", "alternative", "variant", "route", "choice")
HOW_MANY = ("two", "three", "four", "several", "some", "multiple", "a few", "2", "3", "4", "5")
OFFERS = ("we could", "you could", "one way", "possible ways", "the alternatives", "the options")
WEIGHING = ("trade-off", "tradeoff", "pros and cons", "upside", "downside", "versus", " vs ")
#: How a message asks for a decision.
ASKING = ("would you like", "would you prefer", "should i ", "should we ", "shall i ", "do you want", "which of ", "which option", "which approach", "what do you think", "how should ", "let me know which")
#: A choice with its label: a number or one letter.
LABELLED = f"({'|'.join(CHOICES)}) *#?([0-9]+|[a-e])(?![a-z0-9])"


def first_of(c: str | Column, rules: Rules, default: str) -> Column:
    out = None
    for name, pattern in rules:
        hit = F.rlike(col(c), F.lit(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def all_of(c: str | Column, rules: Rules) -> Column:
    return F.array_compact(F.array(*[F.when(F.rlike(col(c), F.lit(p)), F.lit(n)) for n, p in rules]))


def domain(c: str | Column) -> Column:
    return first_of(c, DOMAINS, "general")


def prompt_type(c: str | Column) -> Column:
    text = F.lower(F.trim(col(c)))
    opening = F.lit(False)
    for s in QUESTION_STARTS:
        opening = opening | F.startswith(text, F.lit(s))
    return (
        F.when(F.split(text, r"\s+")[0].isin(*IMPERATIVES), "directive").when(F.endswith(text, F.lit("?")) | opening, "question").when(F.rlike(text, F.lit(CORRECTIONS)), "correction").when(F.rlike(text, F.lit(DEBUGGING)), "debugging").when(F.rlike(text, F.lit(REVIEWS)), "review").otherwise("other")
    )


def episode_type(title: str | Column) -> Column:
    """By a title's beginning or content; a short mark also counts inside other words."""
    t = F.lower(F.coalesce(col(title), F.lit("")))
    has = lambda *xs: F.rlike(t, F.lit("|".join(xs)))
    return F.when(F.startswith(t, F.lit("fix")), "bugfix").when(has("refactor"), "refactor").when(F.startswith(t, F.lit("feat")) | has("add"), "feature").when(has("infra", "ci", "deploy"), "infrastructure").otherwise("implementation")


def commit_type(subject: str | Column) -> Column:
    return first_of(subject, [(p, f"(?i)^{p}(\\([^)]*\\))?!?:") for p in COMMIT_PREFIXES], "other")


def reversibility(c: str | Column) -> Column:
    return first_of(c, [("irreversible", IRREVERSIBLE), ("costly", COSTLY)], "reversible")


def significance(proposal: str | Column, response: str | Column, domain_name: str | Column) -> Column:
    """high for long answers in weighty domains, low for short ones without a reason."""
    words = F.size(F.split(F.trim(col(response)), r"\s+"))
    weighty, reason = col(domain_name).isin("security", "data", "infrastructure"), F.rlike(col(response), F.lit(word("because|since|so that|therefore")))
    return F.when((words >= 40) | (weighty & reason), "high").when((words >= 12) | weighty | reason, "medium").otherwise("low")


def holds_any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def offers_options(c: str | Column) -> Column:
    """Labelled choices, counted choices, a list that an offer opens, items that begin in bold, or words that weigh."""
    text, lines = F.lower(col(c)), F.split(F.lower(col(c)), "\n")
    counted = F.rlike(text, F.lit(f"({'|'.join(HOW_MANY)}) ({'|'.join(x + ('es' if x.endswith('ch') else 's') for x in CHOICES)}|ways)"))
    opened = F.exists(lines, lambda x: F.endswith(F.rtrim(x), F.lit(":")) & holds_any(x, OFFERS))
    bold = F.exists(lines, lambda x: F.rlike(x, F.lit("^ *[0-9]+[.)] +[*][*]")))
    return F.rlike(text, F.lit(LABELLED)) | counted | opened | bold | holds_any(text, WEIGHING)


LEVELS = ("low", "medium", "high")
#: Significance by what kind of decision an exchange was; other kinds are low.
LEVEL_OF_DECISION = {"strategic_redirect": "high", "product_insight": "high", "technical_catch": "medium"}


def escalated(level: str | Column) -> Column:
    """The next level up; the highest and unknown ones stay."""
    return F.when(col(level) == "low", "medium").when(col(level) == "medium", "high").otherwise(col(level))


def significance_of_decision(kind: str | Column) -> Column:
    levels = F.create_map(*[F.lit(x) for kv in LEVEL_OF_DECISION.items() for x in kv])
    return F.coalesce(F.try_element_at(levels, col(kind)), F.lit("low"))


def proposal_type(c: str | Column) -> Column:
    """options, then question; null for neither."""
    return F.when(offers_options(c), "options").when(holds_any(F.lower(col(c)), ASKING), "question")


def option_count(c: str | Column) -> Column:
    """Items of lists (bullets, numbers, letters), else labelled choices; null below two."""
    items = F.size(F.filter(F.split(col(c), "\n"), lambda x: F.rlike(F.ltrim(x), F.lit("^([-*]|[0-9]+[.)]|[A-E][.)]) "))))
    n = F.when(items >= 2, items).otherwise(F.regexp_count(F.lower(col(c)), F.lit(LABELLED)))
    return F.when(n >= 2, n)


#: Beginnings of messages that carry on or hand over a plan, and are no directive of their own.
CARRIED_ON = ("this session is being continued", "implement the following plan", "continue from where", "resume the plan")


def candidate_directive(c: str | Column, least: int = 20) -> Column:
    """A message of at least so many words that does not merely carry on."""
    text = F.lower(F.trim(col(c)))
    on = F.lit(False)
    for mark in CARRIED_ON:
        on = on | F.startswith(text, F.lit(mark))
    return (F.size(F.split(col(c), " ")) >= least) & ~on


def fallback_decision(proposal: str | Column, response: str | Column) -> Column:
    """What rules alone tell about an exchange when no model answers: struct(kind, domain, significance, reversibility)."""
    both_texts = F.concat_ws(" ", col(proposal), col(response))
    kind = F.when(counter_proposal(response, proposal), "counter_proposal").when(F.rlike(col(response), F.lit(CORRECTIONS)), "redirect").when(proposal_type(proposal) == "options", "option_selection").otherwise("approval")
    named = domain(both_texts)
    return F.struct(kind.alias("kind"), named.alias("domain"), significance(proposal, response, named).alias("significance"), reversibility(both_texts).alias("reversibility"))


def novel_words(response: str | Column, proposal: str | Column, least: int = 4) -> Column:
    """Words of at least so many letters in the response that the proposal lacks, each occurrence."""
    find = lambda c: F.regexp_extract_all(F.lower(col(c)), F.lit(f"([a-z]{{{least},}})"), 1)
    known = find(proposal)
    return F.filter(find(response), lambda w: ~F.array_contains(known, w))


def counter_proposal(response: str | Column, proposal: str | Column) -> Column:
    """An answer to options that names none of them and brings three new words or a reversal."""
    ordinal = f"(first|second|third|last|former|latter) ({'|'.join(CHOICES)}|one)"
    names_option = F.rlike(F.lower(col(response)), F.lit(f"{LABELLED}|{ordinal}"))
    return (proposal_type(proposal) == "options") & ~names_option & ((F.size(novel_words(response, proposal)) >= 3) | F.rlike(col(response), F.lit(CORRECTIONS)))


def charged(c: str | Column, allowed: tuple[str, ...] = ("API", "CSS", "HTML", "JSON", "README", "SQL", "TODO", "URL")) -> Column:
    """Short heated messages: a heated word, two exclamation marks, or two words in capitals."""
    text = F.trim(col(c))
    shouts = F.filter(F.regexp_extract_all(text, F.lit(f"{BEFORE}([A-Z][A-Z']{{2,}})"), 2), lambda w: ~w.isin(*allowed))
    return (F.length(text) > 0) & (F.length(text) <= 280) & (F.rlike(text, F.lit(word("ugh|argh|hate|annoying|ridiculous|useless"))) | (F.regexp_count(text, F.lit("!")) >= 2) | (F.size(shouts) >= 2))


def score_band(score: str | Column, confidence: str | Column) -> Column:
    """One of five bands; a confidence under 0.70 takes the one below."""
    names = ["weak", "fair", "solid", "strong", "excellent"]
    s = col(score)
    step = F.when(s < 2, 1).when(s < 4, 2).when(s < 6, 3).when(s < 8, 4).otherwise(5)
    return F.element_at(F.array(*map(F.lit, names)), F.greatest(F.when(col(confidence) < 0.70, step - 1).otherwise(step), F.lit(1)))


def error_class(message: str | Column) -> Column:
    return first_of(message, [("rate_limit", "(?i)(429|rate limit|too many requests)"), ("timeout", "(?i)(timeout|timed out)"), ("parse", "(?i)(parse|unexpected token|invalid json)"), ("auth", "(?i)(401|403|unauthorized|forbidden)"), ("network", "(?i)(connection|refused|reset|dns)")], "other")


def launch_command(c: str | Column) -> Column:
    """Whether a shell command starts a known agent at a command's place, not as an argument."""
    return F.rlike(col(c), F.lit(r"(?m)(^|[;&|(]\s*|(?:^|\s)(?:nohup|exec|time)\s+)\s*(?:[A-Z_]+=\S+\s+)*(?:\S*/)?(codex|gemini|opencode)(\s|$)"))


def launch_cwd(c: str | Column) -> Column:
    found = F.regexp_extract(col(c), r"(?:--cwd|--cd|-C)[ =]+(?:\"([^\"]+)\"|'([^']+)'|(\S+))", 0)
    value = F.regexp_replace(F.regexp_replace(found, r"^(?:--cwd|--cd|-C)[ =]+", ""), "^[\"']|[\"']$", "")
    return F.nullif(value, F.lit(""))
