"""Ordered-event operators.

Every function takes rows, the columns that name a stream (`by`) and the columns that order it (`order`).
All windows of one function share one partitioning and one order, so Spark plans a single exchange and sort.
Rows of one stream are sorted on disk when they exceed memory; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Names = Sequence[str]


def stream(by: Names, order: Names | Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def gap(ts: str, w: WindowSpec) -> Column:
    """Microseconds since the row before; null on the first row."""
    return micros(ts) - F.lag(micros(ts)).over(w)


def event_index(df: DataFrame, by: Names, order: Names, name: str = "idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(stream(by, order)) - 1)


def time_blocks(df: DataFrame, by: Names, ts: str, order: Names, seconds: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows with _b (the block of time) and _gap (to the row before in it), and a row a block with its first and last time,
    the number of gaps over `seconds`, the sum of the others, its size, and the gap to the block before.

    A stream that holds a third of all rows is as many tasks as it has blocks; only the row a block is ordered by stream.
    """
    us = block * 1_000_000
    rows = df.filter(F.col(ts).isNotNull()).withColumn("_b", F.floor(micros(ts) / us))
    rows = rows.withColumn("_gap", gap(ts, stream([*by, "_b"], order)))
    long = F.col("_gap") > seconds * 1_000_000
    sums = rows.groupBy(*by, "_b").agg(F.min(micros(ts)).alias("_first"), F.max(micros(ts)).alias("_last"), F.count_if(long).alias("_breaks"), F.coalesce(F.sum(F.when(~long, F.col("_gap"))), F.lit(0)).alias("_short"), F.count("*").alias("_n"))
    return rows, sums.withColumn("_between", F.col("_first") - F.lag("_last").over(stream(by, ["_b"])))


def islands(df: DataFrame, by: Names, ts: str, order: Names, seconds: int, name: str = "island", block: int = 86_400) -> DataFrame:
    """Numbers runs of rows; a gap of more than `seconds` starts the next one. Null times are dropped first.

    Breaks are counted inside blocks of time, and each block adds the breaks of the blocks before it.
    """
    limit = seconds * 1_000_000
    rows, sums = time_blocks(df, by, ts, order, seconds, block)
    w = stream(by, ["_b"])
    opens = F.coalesce((F.col("_between") > limit).cast("long"), F.lit(0))
    before = F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_breaks").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.sum((F.coalesce(F.col("_gap") > limit, F.lit(False))).cast("long")).over(stream([*by, "_b"], order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_here", here).join(sums.select(*by, "_b", before.alias("_before")), [*by, "_b"])
    return joined.withColumn(name, F.col("_before") + F.col("_here")).drop("_b", "_gap", "_here", "_before")


def gap_sessions(df: DataFrame, by: Names, ts: str, order: Names, seconds: int = 900) -> DataFrame:
    """[first, last] time and size of every island."""
    return islands(df, by, ts, order, seconds).groupBy(*by, "island").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_events"))


def active_seconds(df: DataFrame, by: Names, ts: str, order: Names, longest: int = 5400, block: int = 86_400) -> DataFrame:
    """Sum of the gaps of at most `longest` seconds (microseconds kept), number of rows and the whole span."""
    _, sums = time_blocks(df, by, ts, order, longest, block)
    between = F.when(F.col("_between") <= longest * 1_000_000, F.col("_between")).otherwise(0)
    return sums.groupBy(*by).agg(F.sum(F.col("_short") + between).alias("active_us"), (F.max("_last") - F.min("_first")).alias("span_us"), F.sum("_n").alias("n_events"))


def clusters(df: DataFrame, by: Names, ts: str, order: Names, seconds: int = 7200) -> tuple[DataFrame, DataFrame]:
    """Rows in islands of more than one row, and the rows left over."""
    sized = islands(df, by, ts, order, seconds).withColumn("size", F.count("*").over(Window.partitionBy(*by, "island")))
    return sized.filter("size > 1"), sized.filter("size = 1")


def first_following(value: Column, w: WindowSpec, within: int | None) -> Column:
    """First non-null value in the next `within` rows (all that follow if None)."""
    return F.first(value, ignorenulls=True).over(w.rowsBetween(1, within if within else Window.unboundedFollowing))


def last_preceding(value: Column, w: WindowSpec, within: int | None) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(-within if within else Window.unboundedPreceding, -1))


def response_lookahead(df: DataFrame, by: Names, order: Names, proposal: Column, response: Column, within: int = 3) -> DataFrame:
    """Each proposal with its first response in the next rows, unless another proposal comes first."""
    w, rows = stream(by, order), event_index(df, by, order)
    i = F.col("idx")
    found = rows.withColumn("_p", proposal).withColumn("response_idx", first_following(F.when(response, i), w, within)).withColumn("_other", first_following(F.when(proposal, i), w, within))
    return found.filter("_p AND response_idx IS NOT NULL AND (_other IS NULL OR response_idx < _other)").drop("_p", "_other")


def nearest_context(df: DataFrame, by: Names, order: Names, value: Column, within: int = 5) -> DataFrame:
    """The nearest non-null value before, else the nearest after, inside `within` rows."""
    w = stream(by, order)
    return df.withColumn("nearest", F.coalesce(last_preceding(value, w, within), first_following(value, w, within)))


def any_near(df: DataFrame, by: Names, order: Names, flag: Column, before: int, after: int, name: str) -> DataFrame:
    """Whether any row from `before` rows back to `after` rows on has the flag."""
    return df.withColumn(name, F.coalesce(F.max(flag).over(stream(by, order).rowsBetween(-before, after)), F.lit(False)))


def recovery_distance(df: DataFrame, by: Names, order: Names, error: Column, good: Column) -> DataFrame:
    """Rows from each error to the next good row of its stream; errors that never recover are left out."""
    w, rows = stream(by, order), event_index(df, by, order)
    found = rows.withColumn("_e", error).withColumn("_next", first_following(F.when(good, F.col("idx")), w, None))
    return found.filter("_e AND _next IS NOT NULL").select(*by, "idx", (F.col("_next") - F.col("idx")).alias("distance"))


def retry_ratio(df: DataFrame, by: Names, order: Names, error: Column, command: Column, within: int = 5) -> DataFrame:
    """Per stream: errors with a command before, and those whose last command comes again in the next rows."""
    w = stream(by, order)
    rows = df.withColumn("_e", error).withColumn("_last", last_preceding(command, w, None)).withColumn("_next", F.collect_list(command).over(w.rowsBetween(1, within)))
    errors = rows.filter("_e AND _last IS NOT NULL")
    return errors.groupBy(*by).agg(F.count("*").alias("errors"), F.count_if(F.array_contains("_next", F.col("_last"))).alias("retried"))


def first_before(df: DataFrame, by: Names, order: Names, a: Column, b: Column) -> DataFrame:
    """Whether the first row with a comes before the first with b, or there is no b; false without a."""
    rows = event_index(df.withColumn("_a", a).withColumn("_b", b), by, order)
    firsts = rows.groupBy(*by).agg(F.min(F.when(F.col("_a"), F.col("idx"))).alias("first_a"), F.min(F.when(F.col("_b"), F.col("idx"))).alias("first_b"))
    return firsts.withColumn("a_first", F.expr("first_a IS NOT NULL AND (first_b IS NULL OR first_a < first_b)"))


def segments(df: DataFrame, by: Names, order: Names, start: Column, name: str = "segment") -> DataFrame:
    """Numbers the stretch that follows each start row; rows before the first start are dropped."""
    w = stream(by, order)
    return df.withColumn("_s", start.cast("int")).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(name) > 0)


def rolling_rate(df: DataFrame, by: Names, order: Names, failed: Column, size: int = 50, trip: float = 0.9, run: int = 10) -> DataFrame:
    """Failures among the last `size` outcomes, and the length of the current run of failures; trips on a full window's rate or on a long run."""
    w = stream(by, order)
    recent = w.rowsBetween(-(size - 1), 0)
    rows = df.withColumn("_f", failed.cast("int")).withColumn("n_recent", F.count("*").over(recent)).withColumn("n_failed", F.sum("_f").over(recent))
    rows = rows.withColumn("_ok", F.sum(1 - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("fail_run", F.sum("_f").over(Window.partitionBy(*by, "_ok").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("tripped", ((F.col("n_recent") == size) & (F.col("n_failed") >= trip * size)) | (F.col("fail_run") >= run)).drop("_f", "_ok")


def prefix_sums(df: DataFrame, by: Names, key: str, value: str, name: str, block: int, newest_first: bool = False) -> DataFrame:
    """Running sums in the order of a whole-number key, in blocks of `block` key values.

    Sums of blocks are added up first, a row for each block, and every block then runs by itself: a group that
    holds a third of all rows is as many tasks as it has blocks. Rows that share a key need not have one order among themselves.
    """
    rows = df.withColumn("_b", F.floor(F.col(key) / block))
    order = (lambda c: F.desc(c)) if newest_first else (lambda c: F.asc(c))
    sums = rows.groupBy(*by, "_b").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(Window.partitionBy(*by, "_b").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums.withColumn("_before", before).drop("_s"), [*by, "_b"]).withColumn(name, F.col("_before") + inside).drop("_b", "_before")


def evict_oldest(df: DataFrame, by: Names, age_key: str, size: str, cap: int, block: int = 10_000) -> DataFrame:
    """Marks the oldest rows (least age_key) to drop until what is left holds at most cap."""
    return prefix_sums(df, by, age_key, size, "kept_size", block, newest_first=True).withColumn("evicted", F.col("kept_size") > cap)


def latest(df: DataFrame, by: Names, newest_first: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*newest_first))).filter(F.col("_n") <= n).drop("_n")


def prior(df: DataFrame, by: Names, order: Names, columns: Names) -> DataFrame:
    w = stream(by, order)
    return df.select("*", *[F.lag(c).over(w).alias(f"prior_{c}") for c in columns])


def first_last(df: DataFrame, by: Names, order: Names, value: str) -> DataFrame:
    """First and last value of each stream, by an aggregate without a sort."""
    key = F.struct(*order)
    return df.groupBy(*by).agg(F.min_by(value, key).alias(f"first_{value}"), F.max_by(value, key).alias(f"last_{value}"))


def greedy_chunks(df: DataFrame, by: Names, order: Names, tokens: str, opens: str, budget: int) -> DataFrame:
    """Cuts a stream where the tokens since the last cut would pass the budget, but only at rows that may open a chunk.

    The reset depends on the data, so each stream is folded as one array of (order, tokens, opens); the fold keeps what is open and
    adds a chunk to its list only where it cuts. Returns a row a chunk: chunk (from 0), n_rows, n_tokens.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(tokens).cast("long").alias("_t"), F.col(opens).alias("_o"))))
    done = "array<struct<n_rows:bigint,n_tokens:bigint>>"
    start = F.expr(f"struct(0L AS n_rows, 0L AS n_tokens, cast(array() AS {done}) AS done)")
    closed = lambda a: F.concat(a["done"], F.array(F.struct(a["n_rows"].alias("n_rows"), a["n_tokens"].alias("n_tokens"))))

    def step(a: Column, x: Column) -> Column:
        cut = x["_o"] & (a["n_tokens"] > 0) & (a["n_tokens"] + x["_t"] > budget)
        begun = F.struct(F.lit(1).cast("long").alias("n_rows"), x["_t"].alias("n_tokens"), closed(a).alias("done"))
        return F.when(cut, begun).otherwise(F.struct((a["n_rows"] + 1).alias("n_rows"), (a["n_tokens"] + x["_t"]).alias("n_tokens"), a["done"].alias("done")))

    rows = df.groupBy(*by).agg(items.alias("_items")).select(*by, F.posexplode(F.aggregate("_items", start, step, closed)).alias("chunk", "_x"))
    return rows.select(*by, "chunk", "_x.n_rows", "_x.n_tokens")


def row_numbers(df: DataFrame, by: Names, order: Names, name: str, seconds: int = 21_600, numbers: int = 10_000) -> DataFrame:
    """df with each row's number in its stream (from 1) and `_total`, the rows of the stream.

    Where the first order column is a time or a whole number, rows are numbered inside blocks of it and the rows of the blocks before are
    added: a stream that holds a third of all rows is as many tasks as it has blocks, and only a row a block is ordered by stream. df is
    read twice for it, so this is for rows that are cheap to read.
    """
    kind = dict(df.dtypes).get(order[0])
    if kind in ("timestamp", "timestamp_ntz"):
        block = F.floor(micros(order[0]) / (seconds * 1_000_000))
    elif kind in ("int", "bigint"):
        block = F.floor(F.col(order[0]) / numbers)
    else:
        return df.withColumn(name, F.row_number().over(stream(by, order))).withColumn("_total", F.count("*").over(Window.partitionBy(*by)))
    rows = df.withColumn("_b", F.coalesce(block, F.lit(-(1 << 62))))  # nulls come first
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(*by, "_b", before.alias("_before"), F.sum("_c").over(whole).alias("_total"))
    inside = F.row_number().over(stream([*by, "_b"], order))
    return rows.withColumn("_i", inside).join(placed, [*by, "_b"]).withColumn(name, F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")


def capped(df: DataFrame, by: Names, order: Names, cap: int, exempt: Column) -> DataFrame:
    """The first cap rows of each stream and the exempt rows after them; truncated tells whether any row was dropped."""
    rows = df.withColumn("_n", F.row_number().over(stream(by, order))).withColumn("_keep", (F.col("_n") <= cap) | exempt)
    return rows.withColumn("truncated", F.min("_keep").over(Window.partitionBy(*by)) == F.lit(False)).filter("_keep").drop("_n", "_keep")


def eta(df: DataFrame, by: Names, order: Names, done: str, ts: str, total: int, slack: float = 1.2) -> DataFrame:
    """Seconds left by the slower of the mean and the latest pace, times slack: done is a running count, ts the time of it."""
    w = stream(by, order)
    t, n = micros(ts), F.col(done)
    first = F.first(t).over(w.rowsBetween(Window.unboundedPreceding, 0))
    mean = F.try_divide(t - first, n)
    recent = F.try_divide(t - F.lag(t).over(w), n - F.lag(n).over(w))
    return df.withColumn("eta_s", F.ceil(F.greatest(mean, recent) * F.greatest(F.lit(total) - n, F.lit(0)) * slack / 1_000_000))


def batches(df: DataFrame, by: Names, order: Names, size: int) -> DataFrame:
    """Consecutive batches of a fixed size; the last one may be short."""
    return row_numbers(df, by, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n", "_total")


def even_split(df: DataFrame, by: Names, order: Names, tokens: str, limit: int) -> DataFrame:
    """Cuts each stream into ceil(tokens / limit) slices of one length in rows; the last one may be short."""
    sums = df.groupBy(*by).agg(F.sum(tokens).alias("_t"))
    rows = row_numbers(df, by, order, "_n").join(sums, list(by))
    parts = F.greatest(F.ceil(F.col("_t") / limit), F.lit(1))
    length = F.ceil(F.col("_total") / parts)
    return rows.withColumn("part", F.floor((F.col("_n") - 1) / length)).drop("_n", "_total", "_t")


def result_patch(df: DataFrame, by: Names, order: Names, pending: Column, result: Column) -> DataFrame:
    """Each result with the index of the last pending row that no other result has followed yet."""
    w, rows = stream(by, order), event_index(df, by, order)
    open_row = F.last(F.when(pending, F.col("idx")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    done_row = F.last(F.when(result, F.col("idx")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("_r", result).withColumn("pending_idx", open_row).withColumn("_done", done_row)
    return found.filter("_r AND pending_idx IS NOT NULL AND (_done IS NULL OR _done < pending_idx)").drop("_r", "_done")


def running_groups(df: DataFrame, by: Names, order: Names, boundary: Column, name: str = "group_id") -> DataFrame:
    """Numbers the group that each boundary row opens; rows before the first boundary get 0."""
    return df.withColumn(name, F.sum(boundary.cast("int")).over(stream(by, order).rowsBetween(Window.unboundedPreceding, 0)))
