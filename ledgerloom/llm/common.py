"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import stage

__all__ = ["batches_of", "keep_rows", "numbered", "row_hash", "stage", "table", "values"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_of(rows: Iterable[tuple], schema: pa.Schema, max_rows: int = 4096, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``rows`` that hold at most ``max_rows`` rows and about ``max_bytes`` of strings or bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= max_rows or size >= max_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def values(column: pa.Array) -> Iterator:
    """The values of a column one at a time, so that only one text is held besides the batch."""
    return (x.as_py() for x in column)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def row_hash(text: Column) -> Column:
    """64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` (doc_id, h = row_hash(text), n = rows alike) names, with their own columns.

    ``kept`` has each (doc_id, h) once. Of several rows alike in both, one stays.
    """
    rows = docs.select(F.struct("*").alias("d"), F.col("doc_id").alias("i"), row_hash(F.col("text")).alias("h"))
    hits = lambda k: rows.alias("r").join(k.alias("k"), F.expr("r.i <=> k.doc_id AND r.h = k.h"), "left_semi")
    out = hits(kept.where("n = 1"))
    if not kept.where("n > 1").isEmpty():
        out = out.unionByName(hits(kept.where("n > 1")).dropDuplicates(["i", "h"]))
    return out.select("d.*")


def numbered(rows: DataFrame, group: str, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, … within each value of ``group``, without gaps.

    ``rows`` is a stored table with a column ``row`` made by ``monotonically_increasing_id``, whose
    high bits name the writing task. Rows are numbered inside (group, task), and a running sum over
    the counts of the tasks gives each its offset, so no task ever holds a whole group.
    """
    part = rows.withColumn("_part", F.shiftright("row", 33))
    counts = part.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_from", F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce("_from", F.lit(0)).alias("_from"))
    inner = part.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_part").orderBy("row")))
    joined = inner.join(offsets, F.expr(f"{group} <=> _g AND _part = _p"))
    return joined.withColumn(out, F.col("_from") + F.col("_i") - 1).drop("_part", "_g", "_p", "_from", "_i")
