"""Structured Streaming forms of the ordered-event operators.

A watermark is new here: rows that come later than it are dropped, which a batch never does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.dialects import replay


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def gap_sessions(events: DataFrame, by: str, ts: str, seconds: int = 900, late: str = "1 hour") -> DataFrame:
    """Sessions cut at gaps of more than `seconds`; the end is the last event's time, not the window's end."""
    rows = events.withWatermark(ts, late)
    window = F.session_window(ts, f"{seconds} seconds")
    return rows.groupBy(by, window).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_events")).drop("session_window")


def first_seen(rows: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once while its watermark lasts."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def mutation_ops(lines: DataFrame) -> DataFrame:
    """Lines of mutation logs (path, line_no, line) to operations: path, line_no, pos, op (upsert, rewind or clear), id. A reload is a clear and its messages."""
    v = F.try_parse_json("line")
    name = lambda m: F.coalesce(F.get_json_object(m, "$.id"), F.lit(""))
    messages = F.from_json(F.to_json(F.try_variant_get(v, "$.$set.messages", "variant")), "array<string>")
    op = lambda kind, i: F.struct(F.lit(kind).alias("op"), i.alias("id"))
    loaded = F.concat(F.array(op("clear", F.lit(""))), F.transform(F.filter(messages, lambda m: name(m) != ""), lambda m: op("upsert", name(m))))
    back, own = F.try_variant_get(v, "$.$rewindTo", "string"), F.try_variant_get(v, "$.id", "string")
    said = F.try_variant_get(v, "$.type", "string").isin("user", "gemini") & (own != "")
    ops = F.when(messages.isNotNull(), loaded).when(back.isNotNull(), F.array(op("rewind", back))).when(said, F.array(op("upsert", own)))
    return lines.select("path", "line_no", F.posexplode(ops).alias("pos", "o")).select("path", "line_no", "pos", "o.op", "o.id")


def mutation_log(ops: DataFrame) -> DataFrame:
    """Replays logs per path as operations come, by the same steps as the batch: ops as mutation_ops gives them.

    Emits the number of messages and the ids after each batch; the state of a path is its ids in place.
    """
    import pandas as pd

    has_pos = "pos" in ops.columns

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        order = list(state.get[0]) if state.exists else []
        kept = dict.fromkeys(order, 0)
        rows = pd.concat(list(batches)).sort_values(["line_no", "pos"] if has_pos else ["line_no"])
        replay(kept, order, zip(rows["op"], rows["id"], range(len(rows)), strict=True))
        state.update((order,))
        yield pd.DataFrame({"path": [key[0]], "n": [len(order)], "ids": [order]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return ops.groupBy("path").applyInPandasWithState(fold, "path string, n int, ids array<string>", "ids array<string>", "update", GroupStateTimeout.NoTimeout)


def run_to(stream: DataFrame, path: str, mode: str, state: str) -> None:
    """Runs a stream over what is there into a Parquet folder: appended rows, or (complete, update) the rows of the last batch. state: the checkpoint's folder."""
    write = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = write.format("parquet").option("path", path).start()
    else:
        query = write.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
