"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, new_path, shared_dir, stored  # noqa: F401


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text becomes empty, a null id stays null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def one_of_each(docs: DataFrame, found: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of docs of each component: that of the least doc_id (null last), then of the least hash of its text.

    found: doc_id, row (XXH64 of the text, seed 42), node for every row of docs; roots: node, root of the nodes that are linked.
    A row is known by its doc_id and the hash of its text; rows that share both are one.
    """
    distinct = found.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    rooted = distinct.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = rooted.join(named, "root").select("node", "least")
    lost = found.join(classes, "node").filter("not (doc_id <=> least.doc_id and row = least.row)").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    mine, his, its = unused(docs.columns, "text_hash"), unused(docs.columns, "lost_id"), unused(docs.columns, "lost_row")
    lost = lost.select(F.col("_id").alias(his), F.col("_row").alias(its))
    hashed = docs.withColumn(mine, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = hashed.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(his)) & (F.col(mine) == F.col(its)), "left_anti")
    if not found.groupBy("doc_id", "row").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", mine])
    return kept.drop(mine)


def unused(columns: list[str], name: str) -> str:
    """A column name that is not taken, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def per_text(docs: DataFrame, make: Callable[[], Callable[[list, list], dict[str, list]]], schema: str) -> DataFrame:
    """Maps (doc_id, text) rows batch by batch: make() gives, once a task, a function of ids and texts."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                got = work(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(got[n], type=arrow_type(schema, n)) for n in names], names=names)

    return docs.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 1024, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most so many rows and, but for single rows, bytes of strings."""
    total = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(total)
    at = 0
    while at < batch.num_rows:
        used = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, used + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def arrow_type(schema: str, name: str) -> pa.DataType:
    return next(_ARROW[x.strip().split()[1]] for x in schema.split(",") if x.strip().split()[0] == name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
