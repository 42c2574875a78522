"""Sharding by a hierarchical weighted hash tree.

A document descends from the root to a region, a rack and a shard. At each level every child draws
``-ln(u) / weight`` with u hashed from the doc_id and the child's name, and the least draw wins: each
child gets its share of the weight. A draw depends on the child alone, so when weights change below a
region, documents move into or out of that region only; all others keep their places.

The law is ``key``: doc_id and the number of shards decide. A cluster is laid out as ``BASE`` shards in
racks and regions, and each shard beyond these opens a region of its own (``tree``), so that one more
shard takes documents only into itself.

Defined results: a null doc_id is a key like any other; a null text has no bytes and the CRC of an empty
text; rows with the same doc_id share a shard and have slots of their own; an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import numbered, stage, table

SHARDS, BASE, PER_RACK, RACKS_PER_REGION = 40, 40, 4, 2
#: Bytes that a row needs besides its text.
ROW_BYTES = 16

#: region -> rack -> {shard: weight}
Tree = list[list[dict[int, float]]]


def tree(shards: int, base: int = BASE, per_rack: int = PER_RACK, racks: int = RACKS_PER_REGION) -> Tree:
    """The tree of a cluster of ``shards`` shards of equal weight, numbered from 0."""
    settled = [{s: 1.0 for s in range(at, min(at + per_rack, shards, base))} for at in range(0, min(shards, base), per_rack)]
    regions = [settled[at : at + racks] for at in range(0, len(settled), racks)]
    return regions + [[{s: 1.0}] for s in range(base, shards)]


def _draw(key: Column, weights: list[float], *names) -> Column:
    """The place of the child that wins among children named (*names, 0), (*names, 1), …"""
    ranks = []
    for child, weight in enumerate(weights):
        # 53 bits of the hash as a number between 0 and 1, both excluded
        u = (F.shiftrightunsigned(F.xxhash64(key, *[F.lit(n) for n in (*names, child)]), 11) + 0.5) / float(1 << 53)
        ranks.append(F.struct((-F.log(u) / weight).alias("score"), F.lit(child).alias("child")))
    return F.array_min(F.array(*ranks))["child"] if len(ranks) > 1 else F.lit(0)


def shard_of(key: Column, cluster: Tree) -> Column:
    """The shard of a key, as a column expression."""
    region = _draw(key, [sum(w for rack in racks for w in rack.values()) for racks in cluster], "region")
    picks = []
    for r, racks in enumerate(cluster):
        shards = []
        for k, rack in enumerate(racks):
            names = sorted(rack)
            shards.append(F.element_at(F.array(*map(F.lit, names)), _draw(key, [rack[s] for s in names], "shard", r, k) + 1))
        rack = _draw(key, [sum(x.values()) for x in racks], "rack", r)
        picks.append(_nth(rack, shards))
    return _nth(region, picks).cast("int")


def _nth(index: Column, options: list[Column]) -> Column:
    """options[index]; only the chosen option is evaluated."""
    out = options[-1]
    for k in range(len(options) - 2, -1, -1):
        out = F.when(index == k, options[k]).otherwise(out)
    return out


def assign(docs: DataFrame, cluster: Tree, grown: Tree | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot and grown_shard, its shard in ``grown``.

    Slots number the rows of a shard from 0 without gaps. Texts are not shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), cluster).alias("shard"),
        (shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    return numbered(stage(rows, "shards"), "shard", "slot").drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents"), tree(SHARDS), tree(SHARDS + 1))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
