"""Exact top-k search by columnar branch-and-bound.

Vectors are turned into integers, floor(1024 x), and packed into blocks in vertical layout: one row per
dimension. Every block of queries meets every block of candidates once. There, products are summed up
dimension block by dimension block. By Cauchy and Schwarz, what the dimensions not yet seen can add to
or take from a score is at most the product of the two vectors' remaining lengths; a candidate whose
best possible score is below the k-th best guaranteed score is dropped, and the survivors are compacted
before the next block of dimensions. Each pair of blocks yields k rows per query at most, and one
ranking over these gives the result.

Sums are exact: as floats while every product sum stays below 2**53, as Python integers beyond, with
results clamped to a long.

Defined results: vectors that are null, or hold null, NaN or infinite components, take no part, nor do
rows with a null vec_id; vectors of different lengths have no score and meet in no block; empty vectors
score 0. A query's own row is every row with its vec_id; of several query rows with one vec_id, the
ranking takes all scores together. Ties go to the smaller vec_id. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import batches_of, numbered, stage, table

TOP, EVERY = 10, 100
SCALE = 1024
#: Candidates and queries of a block; dimensions taken at a time.
CANDIDATES, QUERIES, DIMENSIONS = 4096, 256, 16
#: Blocks of candidates that a block of queries meets in one place.
LANE = 2

_LONG = (1 << 63) - 1


def _packed(vectors: DataFrame, per_block: int, name: str) -> DataFrame:
    """(dims, block, ids, cells, kind): blocks of vectors, ``cells`` holding them dimension by dimension."""
    rows = stage(vectors.withColumn("dims", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()), f"{name}-rows")
    placed = numbered(rows, "dims", "i").withColumn("block", F.floor(F.col("i") / per_block))

    def pack(table_):
        cells = table_.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        grid = np.floor(cells * SCALE).reshape(table_.num_rows, -1).T
        most = float(np.abs(grid).max()) if grid.size else 0.0
        kind = "i2" if most < 2**15 else "i4" if most < 2**31 else "f8"
        return pa.table(
            {
                "dims": pa.array([len(grid)], pa.int32()),
                "block": pa.array([table_.column("block")[0].as_py()], pa.int64()),
                "ids": pa.array([table_.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                "cells": pa.array([np.ascontiguousarray(grid.astype(kind)).tobytes()], pa.binary()),
                "kind": [kind],
                "most": [most],
            }
        )

    blocks = placed.groupBy("dims", "block").applyInArrow(pack, "dims int, block long, ids array<long>, cells binary, kind string, most double")
    return stage(blocks, f"{name}-blocks")


def search_block(queries: np.ndarray, query_ids: list[int], cells: np.ndarray, ids: np.ndarray, k: int, step: int = DIMENSIONS) -> Iterator[tuple[int, int, int]]:
    """The k best (query_id, vec_id, score) per row of ``queries`` among the columns of ``cells``.

    ``queries`` is (n, dims), ``cells`` (dims, m); both hold integers as floats, small enough that sums are exact.
    """
    dims, count = cells.shape
    starts = list(range(0, dims, step))
    mass = lambda x: np.sqrt(np.concatenate([np.cumsum([(x[:, s : s + step] ** 2).sum(axis=1) for s in starts][::-1], axis=0)[::-1], np.zeros((1, len(x)))]))
    left_q = mass(queries) if dims else np.zeros((1, len(queries)))
    left_c = mass(cells.T) if dims else np.zeros((1, count))
    opening = queries[:, :step] @ cells[:step] if dims else np.zeros((len(queries), count))
    for n, own in enumerate(query_ids):
        alive, score = np.nonzero(ids != own)[0], opening[n]
        score = score[alive]
        for b in range(1, len(starts) + 1):
            if len(alive) > k:
                slack = left_q[b, n] * left_c[b, alive] * (1 + 1e-9) + 1e-6  # rounding never drops a candidate
                floor = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                stay = score + slack >= floor
                if not stay.all():
                    alive, score = alive[stay], score[stay]
            if b < len(starts):
                at = slice(starts[b], starts[b] + step)
                score = score + queries[n, at] @ (cells[at] if len(alive) == count else cells[at].take(alive, axis=1))
        best = np.lexsort((ids[alive], -score))[:k]
        for i in best:
            yield own, int(ids[alive[i]]), int(score[i])


def _search_big(queries: np.ndarray, query_ids: list[int], cells: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """The same for numbers beyond exact float sums."""
    columns = [[int(x) for x in column] for column in cells.T]
    for query, own in zip(queries, query_ids, strict=True):
        row = [int(x) for x in query]
        scores = [(max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(row, column, strict=True)))), i) for column, i in zip(columns, ids.tolist(), strict=True) if i != own]
        for score, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]:
            yield own, i, score


def _grid(batch: pa.RecordBatch, side: str, dims: int, i: int) -> np.ndarray:
    cells = np.frombuffer(batch.column(f"{side}cells")[i].as_buffer(), batch.column(f"{side}kind")[i].as_py())
    return cells.reshape(dims, -1 if dims else len(batch.column(f"{side}ids")[i])).astype(np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best other rows for each row that ``is_query`` names."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(usable & finite)
    double = F.col("embedding").cast("array<double>").alias("embedding")
    candidates = _packed(good.select("vec_id", double), CANDIDATES, "candidates")
    queries = _packed(good.where(is_query).select("vec_id", double), QUERIES, "queries")
    # A lane is a few blocks of candidates; every block of queries visits every lane of its length.
    lanes = candidates.groupBy("dims").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    there = candidates.join(lanes, "dims").withColumn("lane", F.pmod("block", "lanes").cast("int"))
    asked = queries.join(lanes, "dims").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    asked = asked.select("dims", "lane", *[F.col(c).alias(f"q_{c}") for c in ("ids", "cells", "kind", "most")])
    pairs = asked.join(there.drop("lanes", "block"), ["dims", "lane"])
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch.column("dims")[i].as_py()
                (query_ids, queries, q_most), (ids, cells, most) = (
                    (batch.column(f"{side}ids")[i].values.to_numpy(), _grid(batch, side, dims, i), batch.column(f"{side}most")[i].as_py()) for side in ("q_", "")
                )
                exact = q_most * most * dims < 2**53
                yield from (search_block if exact else _search_big)(queries.T, query_ids.tolist(), cells, ids, k)

    found = pairs.mapInArrow(lambda batches: batches_of(rows(batches), schema), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS MATERIALIZED (
       SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
       WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                  CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
