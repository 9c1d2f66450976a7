"""Sessions, decisions and episodes: scopes, link confidence, delegation counts, progress and cache counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .links import overlap_pairs, shared_members

Names = Sequence[str]

#: Kinds of decisions that count as of high value. Fixed values.
HIGH_VALUE = ("strategic_redirect", "technical_catch", "product_insight")
#: Confidence of an episode without links, and of one that is a lone session.
WITHOUT_LINKS, LONE = 0.5, 0.3
#: Narrative states that count as finished work of a child.
FINISHED = ("complete", "low_quality")


def logical_root(is_subagent: Column, triggered_by: Column) -> Column:
    """A session that a person began: no sub-session, and launched by no other tool."""
    return ~F.coalesce(is_subagent, F.lit(False)) & triggered_by.isNull()


def decision_scopes(repository: str | None = None, law: str | None = None) -> dict[str, Column]:
    """Predicates over decisions by name. Columns: status, significance, repository, embedding, proposal_type, agent_recognized, chain_id, decision_type, law_key."""
    c = F.col
    kind = lambda x: c("proposal_type") == x
    scopes = {
        "open": c("status") == "open",
        "strategic": c("significance") == "strategic",
        "embedded": c("embedding").isNotNull(),
        "counter_proposals": kind("counter_proposal"),
        "proactive_insights": kind("proactive_insight"),
        "agent_recognized": c("agent_recognized"),
        "in_chain": c("chain_id").isNotNull(),
        "high_value": c("decision_type").isin(*HIGH_VALUE),
        "classified": c("decision_type").isNotNull(),
        "with_law": c("law_key").isNotNull(),
    }
    if repository is not None:
        scopes["for_repository"] = c("repository") == repository
    if law is not None:
        scopes["for_law"] = c("law_key") == law
    return {n: F.coalesce(p, F.lit(False)) for n, p in scopes.items()}


def scorable(texts: Names, arrays: Names, count: str) -> Column:
    """Whether an episode has any evidence: a text that is not blank, an array that is not empty, or a positive count."""
    out = F.coalesce(F.col(count) > 0, F.lit(False))
    for t in texts:
        out = out | (F.coalesce(F.trim(t), F.lit("")) != "")
    for a in arrays:
        out = out | (F.coalesce(F.size(a), F.lit(0)) > 0)
    return out


def episode_confidence(groups: DataFrame, links: DataFrame, sessions: DataFrame, group: Names, session: Names) -> DataFrame:
    """kind (group or session), the key as text, confidence: the mean confidence of a group's links to two digits, a half without links, 0.3 for sessions that nothing links to."""
    mean = links.groupBy(*group).agg(F.avg(F.col("confidence").cast("decimal(18,9)")).alias("_c"))
    lone = sessions.join(links.select(*session).distinct(), list(session), "left_anti")
    return confidences(groups, mean.select(*group, F.round("_c", 2).cast("double").alias("confidence")), lone, group, session)


def confidences(groups: DataFrame, means: DataFrame, lone: DataFrame, group: Names, session: Names) -> DataFrame:
    """The rows of episode_confidence from the means themselves (group, confidence) and the sessions that nothing links to."""
    key = lambda names: F.concat_ws(":", *names).alias("key")
    found = groups.join(means, list(group), "left").select(F.lit("group").alias("kind"), key(group), F.coalesce("confidence", F.lit(WITHOUT_LINKS)).alias("confidence"))
    return found.unionAll(lone.select(F.lit("session").alias("kind"), key(session), F.lit(LONE)))


def committed_returns(events: DataFrame, children: DataFrame, session: str = "session") -> DataFrame:
    """Sessions with a dispatch whose id has a return after it, and either a child that committed or a commit of their own after the first return.

    events: session, idx, type, tool_use_id; children: parent (a session), shipped.
    """
    kind = lambda t: F.col("type") == t
    sent = events.filter(kind("subagent_dispatch")).select(session, "tool_use_id", F.col("idx").alias("sent"))
    back = events.filter(kind("subagent_return")).select(session, "tool_use_id", F.col("idx").alias("back"))
    matched = sent.join(back, [session, "tool_use_id"]).filter("back > sent").select(session).distinct()
    own = events.groupBy(session).agg(F.min(F.when(kind("subagent_return"), F.col("idx"))).alias("_r"), F.max(F.when(kind("git_commit"), F.col("idx"))).alias("_c"))
    late = own.filter("_c > _r").select(session)
    shipped = children.filter("shipped").select(F.col("parent").alias(session))
    return matched.join(late.unionAll(shipped).distinct(), session, "left_semi")


def dispatch_ratio(events: DataFrame, children: DataFrame, by: Names, session: str = "session") -> DataFrame:
    """Per group: dispatches, and the share of dispatching sessions whose returns were committed (two digits; null and 0 without dispatches)."""
    sent = events.groupBy(*by, session).agg(F.count_if(F.col("type") == "subagent_dispatch").alias("_n"))
    good = committed_returns(events, children, session).withColumn("_good", F.lit(1))
    rows = sent.join(good, session, "left")
    found = rows.groupBy(*by).agg(F.sum("_n").alias("dispatches"), F.count_if(F.col("_n") > 0).alias("_d"), F.count_if((F.col("_n") > 0) & F.col("_good").isNotNull()).alias("_g"))
    return found.select(*by, "dispatches", F.round(F.try_divide(F.col("_g"), F.col("_d")), 2).alias("ratio"))


def parallelism(events: DataFrame, sessions: DataFrame, windows: DataFrame, groups: DataFrame) -> DataFrame:
    """Nine counts of one row about delegated work.

    sessions: session, parent (null for orphans), is_subagent, shipped, launched_by (a session, null), narrative; windows: session, start_ts, end_ts
    of its active time; groups: session, group (commit groups that a session contributed to); events as committed_returns takes them.
    """
    subs = sessions.filter("is_subagent")
    mains = sessions.filter("NOT is_subagent")
    kids = subs.filter("parent IS NOT NULL")
    own = events.join(mains.select("session"), "session", "left_semi")
    kept = committed_returns(own, kids.select("parent", "shipped"))
    busy = windows.join(kids.filter("shipped").select("session", "parent"), "session")
    a = busy.select("parent", F.col("session").alias("a_id"), F.col("start_ts").alias("a_start"), F.col("end_ts").alias("a_end"))
    b = busy.select("parent", F.col("session").alias("b_id"), F.col("start_ts").alias("b_start"), F.col("end_ts").alias("b_end"))
    pairs = overlap_pairs(a, b, ["parent"]).filter("a_id < b_id").select("a_id", "b_id").distinct()
    shared = shared_members(groups.join(kids.select("session", "parent"), "session"), ["parent"], "session", "group")
    finished = sessions.filter(F.col("launched_by").isNotNull() & F.col("narrative").isin(*FINISHED))
    tool = finished.join(mains.select(F.col("session").alias("launched_by")), "launched_by", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(kept, "dispatch_with_committed_return_count"),
        count(pairs, "concurrent_pairs_with_ships_count"),
        count(shared, "review_separation_count"),
        subs.agg(F.count_if(F.col("parent").isNull()).alias("orphan_subagent_count"), F.count("*").alias("subagent_count")),
        own.agg(F.count_if(F.col("type") == "subagent_dispatch").alias("dispatch_count"), F.count_if(F.col("type") == "subagent_return").alias("return_count")),
        tool.agg(F.count_distinct("launched_by").alias("cross_tool_delegation_count"), F.count("*").alias("cross_tool_child_completed_count")),
    ]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:  # one row each
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def progress_percentage(status: Column, done: Column, total: Column) -> Column:
    """Progress in whole percent by phase; the phase of analysis runs from 15 to 85 with its sessions."""
    share = F.try_divide(done.cast("double"), total.cast("double"))
    fixed = {"complete": 100, "failed": 0, "pending": 2, "extracting": 2, "parsing": 10, "aggregating": 90}
    out = F.when(status == "analyzing", F.coalesce(F.round(15 + share * 70), F.lit(15)))
    for name, n in fixed.items():
        out = out.when(status == name, n)
    return out.otherwise(F.coalesce(F.round(share * 100), F.lit(0))).cast("int")


def cache_counters(lookups: DataFrame, service: str, hit: Column) -> DataFrame:
    """Hits, misses and the hit rate in whole percent of each service, and of all under a null service, in one pass."""
    counts = lookups.groupBy(service).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    sums = counts.rollup(service).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    return sums.withColumn("percent", F.round(F.try_divide(100 * F.col("hits"), F.col("hits") + F.col("misses"))).cast("int"))


def project_groups(dirs: DataFrame) -> DataFrame:
    """dirs: name, remote, cwd, sessions. Groups by remote, else by local:<cwd>, else unknown: group, members (joined by |, in order), dirs, sessions."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    key = F.coalesce(blank("remote"), F.concat(F.lit("local:"), blank("cwd")), F.lit("unknown"))
    found = dirs.withColumn("group", key).groupBy("group")
    return found.agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("members"), F.count("*").alias("dirs"), F.sum("sessions").alias("sessions"))


def outcome_signals(events: DataFrame, by: Names, plan: str = r"(^|/)plans?/|PLAN") -> DataFrame:
    """Distinct files changed, plan files among them, test runs, passes, errors and the pass rate of each session. events: type, path, failed."""
    changed = F.col("type").isin("file_edit", "file_create")
    is_plan = F.rlike(F.coalesce("path", F.lit("")), F.lit(plan))
    test = F.col("type") == "test_run"
    found = events.groupBy(*by).agg(
        F.count_distinct(F.when(changed & ~is_plan, F.col("path"))).alias("files"),
        F.count_distinct(F.when(changed & is_plan, F.col("path"))).alias("plan_files"),
        F.count_if(test).alias("tests"),
        F.count_if(test & (F.col("failed") == 0)).alias("passes"),
        F.count_if(F.col("type") == "error_encountered").alias("errors"),
    )
    return found.withColumn("pass_rate", F.round(F.try_divide("passes", "tests"), 3))


def first_by(df: DataFrame, by: Names, order: Sequence[Column]) -> DataFrame:
    """One row of each group, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")
