"""Hard-negative mining by a secondary-sort shuffle.

Scores of (anchor, row) pairs are packed into binary keys that sort as (anchor, descending score, vec_id).
The keys are dealt by anchor and sorted by the shuffle (repartitionAndSortWithinPartitions), and an iterator
reads every anchor's rows from the best score down. A row of the anchor's own label opens a window below its
score, until enough are open; a row of another label goes to every open window that its score lies in, and
leaves it when the window has its negatives. Nothing but the windows and a few tied rows is held, whatever
the number of an anchor's rows.

Before the shuffle, blocks of rows meet blocks of anchors and only send what can matter: of a block's rows of
the anchor's label the best few, and of the others the first few inside each of the windows that the anchor's
positives, found by a first pass of the same kind, will open. That is a combiner: what it leaves out, other
rows of the block precede in every window, so the result is that of all pairs.

Defined results: rows with a null vec_id or label, or a vector that is null or holds null, NaN or infinite
components, take no part; vectors of different lengths have no score; empty vectors score 0. An anchor's other
rows are those of another vec_id; of several anchor rows with one vec_id each has positives and negatives of its
own; repeated rows count singly. Positives and negatives go by score, ties by vec_id. Scores are exact, and
clamped to a long. Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import batches_of, numbered, stage, table

SCALE, EVERY = 256, 100
POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score below the positive's, in percent.
LOW, HIGH = 30, 90
#: Rows and anchors of a block; blocks of rows that a block of anchors meets in one place.
ROWS, ANCHORS, LANE = 4096, 256, 2

_TOP = 1 << 63
_LEAST, _MOST = -_TOP, _TOP - 1
_KEY = struct.Struct(">QqQQ?")
_ANCHOR = 16  # bytes of a key that name the anchor


def pack(anchor: int, row: int, score: int, vec_id: int, same: bool) -> bytes:
    """A key that sorts by anchor, descending score and vec_id; ``row`` tells anchors with one vec_id apart."""
    return _KEY.pack(anchor + _TOP, row, _MOST - score, vec_id + _TOP, same)


def unpack(key: bytes) -> tuple[int, int, int, int, bool]:
    anchor, row, score, vec_id, same = _KEY.unpack(key)
    return anchor - _TOP, row, _MOST - score, vec_id - _TOP, same


def windows(keys: Iterable[bytes], positives: int = POSITIVES, negatives: int = NEGATIVES) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from keys in their order."""
    owner, opened, open_, at, ties = None, 0, [], None, []

    def offer(window: list, vec_id: int, score: int):
        own, anchor, top, count = window
        if LOW * top <= 100 * score <= HIGH * top:
            window[3] = count + 1
            return anchor, own, count + 1, vec_id, top, score
        return None

    for key in keys:
        anchor, _, score, vec_id, same = unpack(key)
        if key[:_ANCHOR] != owner:
            owner, opened, open_, at, ties = key[:_ANCHOR], 0, [], None, []
        if score != at:
            at, ties = score, []
        if same:
            if opened < positives:
                opened += 1
                window = [vec_id, anchor, score, 0]
                open_.append(window)
                for tied in ties:  # a window of score 0 also holds the negatives that came before it
                    if found := offer(window, tied, score):
                        yield found
        else:
            if len(ties) < negatives:
                ties.append(vec_id)
            for window in open_:
                if window[3] < negatives and (found := offer(window, vec_id, score)):
                    yield found
            # scores only fall: windows that are full or lie wholly above the row have ended
            open_ = [w for w in open_ if w[3] < negatives and 100 * score >= LOW * w[2]]


def _packed(rows: DataFrame, per_block: int, name: str) -> DataFrame:
    """(dims, block, ids, marks, labels, tops, cells, kind, most): blocks of rows, ``cells`` a row-major grid of integers.

    ``rows``: vec_id, mark, label, tops (scores of known positives), embedding (doubles).
    """
    held = stage(rows.withColumn("dims", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()), f"{name}-rows")
    placed = numbered(held, "dims", "i").withColumn("block", F.floor(F.col("i") / per_block))

    def block(table_: pa.Table) -> pa.Table:
        cells = table_.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        grid = np.floor(cells * SCALE)
        most = float(np.abs(grid).max()) if grid.size else 0.0
        kind = "i2" if most < 2**15 else "i4" if most < 2**31 else "f8"
        lists = {c: pa.array([table_.column(c).to_pylist()], pa.list_(t)) for c, t in (("vec_id", pa.int64()), ("mark", pa.int64()), ("label", pa.int64()), ("tops", pa.list_(pa.int64())))}
        return pa.table(
            {
                "dims": pa.array([table_.column("dims")[0].as_py()], pa.int32()),
                "block": pa.array([table_.column("block")[0].as_py()], pa.int64()),
                "ids": lists["vec_id"],
                "marks": lists["mark"],
                "labels": lists["label"],
                "tops": lists["tops"],
                "cells": pa.array([grid.astype(kind).tobytes()], pa.binary()),
                "kind": [kind],
                "most": [most],
            }
        )

    schema = "dims int, block long, ids array<long>, marks array<long>, labels array<long>, tops array<array<long>>, cells binary, kind string, most double"
    return stage(placed.groupBy("dims", "block").applyInArrow(block, schema), f"{name}-blocks")


def _met(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of rows of its length, the rows' blocks dealt over lanes."""
    lanes = rows.groupBy("dims").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    there = rows.join(lanes, "dims").withColumn("lane", F.pmod("block", "lanes").cast("int")).select("dims", "lane", "ids", "labels", "cells", "kind", "most")
    asked = anchors.join(lanes, "dims").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    own = ("ids", "marks", "labels", "tops", "cells", "kind", "most")
    return asked.select("dims", "lane", *[F.col(c).alias(f"a_{c}") for c in own]).join(there, ["dims", "lane"])


def _grid(batch: pa.RecordBatch, side: str, i: int) -> np.ndarray:
    count = len(batch.column(f"{side}ids")[i])
    return np.frombuffer(batch.column(f"{side}cells")[i].as_buffer(), batch.column(f"{side}kind")[i].as_py()).reshape(count, batch.column("dims")[i].as_py())


def _scores(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Scores of anchors (rows) and rows (columns) of one pair of blocks, as longs."""
    a, b = _grid(batch, "a_", i), _grid(batch, "", i)
    if batch.column("a_most")[i].as_py() * batch.column("most")[i].as_py() * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    rows = [[int(x) for x in y] for y in b]
    return np.array([[max(_LEAST, min(_MOST, sum(int(p) * q for p, q in zip(x, y, strict=True)))) for y in rows] for x in a], np.int64).reshape(len(a), len(b))


def best(score: np.ndarray, ids: np.ndarray, among: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` places of ``among`` by descending score and id."""
    if len(among) > count:
        floor = np.partition(score[among], len(among) - count)[len(among) - count]
        among = among[score[among] >= floor]
    return among[np.lexsort((ids[among], ~score[among]))[:count]]  # ~x falls as x rises, without overflow


def inside(score: np.ndarray, top: int) -> np.ndarray:
    """Which scores lie in the window below a positive's score, by whole bounds without overflow."""
    return (score >= -(-LOW * top // 100)) & (score <= HIGH * top // 100)


def _needed(batches: Iterable[pa.RecordBatch], with_negatives: bool) -> Iterator[tuple]:
    """(mark, score, vec_id, key) of the pairs that a pair of blocks sends on."""
    for batch in batches:
        for i in range(batch.num_rows):
            scores = _scores(batch, i)
            a_ids, marks, a_labels, ids, labels = (batch.column(c)[i].values.to_numpy() for c in ("a_ids", "a_marks", "a_labels", "ids", "labels"))
            tops = batch.column("a_tops")[i].as_py()
            for n, score in enumerate(scores):
                alike, other = labels == a_labels[n], ids != a_ids[n]
                take = set(best(score, ids, np.nonzero(alike & other)[0], POSITIVES).tolist())
                for top in set(tops[n]) if with_negatives else ():
                    take.update(best(score, ids, np.nonzero(~alike & other & inside(score, top))[0], NEGATIVES).tolist())
                for k in take:
                    yield int(marks[n]), int(score[k]), int(ids[k]), pack(int(a_ids[n]), int(marks[n]), int(score[k]), int(ids[k]), bool(alike[k]))


def _keys(pairs: DataFrame, with_negatives: bool) -> DataFrame:
    schema = pa.schema([("mark", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("key", pa.binary())])
    return pairs.mapInArrow(lambda batches: batches_of(_needed(batches, with_negatives), schema, max_rows=65_536), "mark long, score long, vec_id long, key binary")


def mine(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """Hard negatives of the rows that ``is_anchor`` names; ``vectors``: vec_id, label, embedding."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("asks"))
    none = F.array().cast("array<long>").alias("tops")
    rows = _packed(good.select("vec_id", F.lit(0).cast("long").alias("mark"), "label", none, "embedding"), ROWS, "mine")
    asking = stage(good.where("asks").select("vec_id", F.monotonically_increasing_id().alias("mark"), "label", "embedding"), "mine-anchors")
    # the scores of each anchor's positives bound what the blocks have to send
    first = _keys(_met(_packed(asking.select("vec_id", "mark", "label", none, "embedding"), ANCHORS, "mine-first"), rows), False)
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("mark").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("r") <= POSITIVES)
    tops = ranked.groupBy("mark").agg(F.collect_list("score").alias("tops"))
    known = asking.join(tops, "mark").select("vec_id", "mark", "label", "tops", "embedding")
    keys = _keys(_met(_packed(known, ANCHORS, "mine-known"), rows), True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select("key").rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:_ANCHOR]))
    found = ordered.mapPartitions(lambda part: windows(key for key, _ in part))
    return spark.createDataFrame(found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's table: every seventh vec_id counts under the next label."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END")
    return vectors.select("vec_id", label.alias("label"), "embedding")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS MATERIALIZED (
       SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
       FROM embeddings
       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS MATERIALIZED (
       SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
       FROM v a JOIN v c ON a.vec_id % {EVERY} = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
     p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
     n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
           FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
