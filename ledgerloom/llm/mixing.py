"""Mixing sources to target weights by proportionally fair (Pfair) scheduling of blocks.

The documents of a source, as they are read, are cut into blocks. With integer weights w of sum W, the
k-th block of a source may start at slot ``k * W // w`` and is due at slot ``ceil((k + 1) * W / w)``.
Each slot takes the released block that is due first. Since the weights sum up to one block a slot,
every block meets its deadline, so after any number of slots a source has had its share of blocks, less
or more than it by under one block.

The schedule repeats after W slots. The driver works out one such round for the sources at hand and
places blocks by arithmetic; when a source runs out, a new phase begins with the rest. What the driver
holds depends on the number of sources and on W, not on the documents. Nothing is dropped or repeated:
what is left when other sources have run out comes last.

Defined results: documents with a null source are a source of their own; sources without a weight get
``DEFAULT_WEIGHT``; repeated rows are mixed like any others; an empty table gives an empty result.
Extra columns are not read by ``positions`` and pass through ``mix``.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import numbered, stage, table

#: Documents of a block.
BLOCK = 16
#: A plan row per source goes to every task.
MAX_SOURCES = 10_000
DEFAULT_WEIGHT = 4
#: Production weights: the large crawl counts double, three curated sources more than the others.
WEIGHTS = {"src0": 8, "src1": 6, "src2": 6, "src3": 6}


def one_round(weights: Mapping) -> list:
    """The source of each of the W slots of a round, earliest deadline first among released blocks."""
    total = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is None, s))
    waiting = [(0, rank, 0) for rank in range(len(names))]  # (release, source, block)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, rank, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[names[rank]]), rank, k))
        _, rank, k = heapq.heappop(ready)
        out.append(names[rank])
        if k + 1 < weights[names[rank]]:
            heapq.heappush(waiting, ((k + 1) * total // weights[names[rank]], rank, k + 1))
    return out


def phases(blocks: Mapping, weights: Mapping) -> list[tuple]:
    """(source, first block, first slot of the phase, W, weight, slots of the source in a round) for each phase.

    ``blocks``: blocks of each source. In a phase a source's blocks follow the round over and over; the
    phase ends before the first slot whose source has no block left.
    """
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        now = {s: weights.get(s, DEFAULT_WEIGHT) for s in left}
        plan = one_round(now)
        rounds = min(n // now[s] for s, n in left.items())
        rest = {s: n - rounds * now[s] for s, n in left.items()}
        extra = 0
        while rest[plan[extra % len(plan)]]:  # ends within a round: some source has less than a round left
            rest[plan[extra % len(plan)]] -= 1
            extra += 1
        for s in left:
            out.append((s, done[s], start, len(plan), now[s], [slot for slot, x in enumerate(plan) if x == s]))
            done[s] += left[s] - rest[s]
        start += rounds * len(plan) + extra
        left = {s: n for s, n in rest.items() if n}
    return out


def positions(docs: DataFrame, weights: Mapping = WEIGHTS, block: int = BLOCK, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keys``, source, block, slot and position, gapless from 0."""
    if min(weights.values(), default=1) < 1:
        raise ValueError("weights are positive integers")
    rows = stage(docs.select(*keys, "source").withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"{len(counts)} sources; the plan that every task gets is made for {MAX_SOURCES} at most")
    kind = docs.schema["source"].dataType.simpleString()
    planned = [(s, [p[1:] for p in group]) for s, group in _by_source(phases({s: -(-n // block) for s, n in counts.items()}, weights)).items()]
    plan = docs.sparkSession.createDataFrame(planned, f"s {kind}, phases array<struct<first:long,start:long,total:long,weight:long,slots:array<long>>>")
    placed = numbered(rows, "source", "i").withColumn("block", F.floor(F.col("i") / block))
    placed = placed.join(F.broadcast(plan), F.expr("source <=> s"))  # bounded by MAX_SOURCES
    placed = placed.withColumn("p", F.expr("element_at(filter(phases, p -> p.first <= block), -1)")).withColumn("k", F.col("block") - F.col("p.first"))
    slot = F.expr("p.start + (k div p.weight) * p.total + p.slots[cast(k % p.weight AS int)]")
    placed = stage(placed.select(*keys, "source", "i", "block", slot.alias("slot")), "mix-slots")
    # The last block of a source may be short; what it lacks moves all later slots up.
    ends = placed.groupBy("source").agg(F.max(F.struct("slot", "i")).alias("last")).select("last.*").collect()
    short = [(r["slot"], block - 1 - r["i"] % block) for r in ends]
    lacks = F.lit(0)
    if short:
        gaps = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(n).alias("n")) for at, n in short])
        lacks = F.aggregate(gaps, F.lit(0), lambda total, g: total + F.when(g["at"] < F.col("slot"), g["n"]).otherwise(0))
    return placed.withColumn("position", (F.col("slot") * block + F.col("i") % block - lacks).cast("long")).drop("i")


def _by_source(plan: list[tuple]) -> dict:
    """The phases of each source in which it has slots to fill, in order."""
    out: dict = {}
    for p in plan:
        group = out.setdefault(p[0], [])
        if group and group[-1][1] == p[1]:
            group.pop()  # it placed no block in that phase
        group.append(p)
    return out


def mix(docs: DataFrame, weights: Mapping = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """All documents with their own columns, laid out in the order of the mixture: files in order, rows in order.

    Rows that are alike in every column are interchangeable; each takes one of their positions.
    """
    spark = docs.sparkSession
    hashed = [F.col(f"d.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("d"), "doc_id", "source").withColumn("h", F.xxhash64(*hashed))
    place = stage(positions(rows.select("doc_id", "source", "h"), weights, block, ("doc_id", "h")), "mix-places")
    same = "r.doc_id <=> p.doc_id AND r.h = p.h"
    alike = stage(place.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "h"), "mix-alike")
    if alike.isEmpty():
        found = rows.alias("r").join(place.alias("p"), F.expr(same))
    else:
        single = place.alias("r").join(alike.alias("p"), F.expr(same), "left_anti")
        found = rows.alias("r").join(single.alias("p"), F.expr(same)).select("r.*", "p.position")
        more = rows.alias("r").join(alike.alias("p"), F.expr(same), "left_semi").dropDuplicates(["doc_id", "h"])
        copies = place.alias("r").join(alike.alias("p"), F.expr(same), "left_semi")
        found = found.unionByName(more.alias("r").join(copies.alias("p"), F.expr(same)).select("r.*", "p.position"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, -(-place.count() // parts))
    laid = found.select("d", "position").repartitionById(parts, F.floor(F.col("position") / each).cast("int"))
    return laid.sortWithinPartitions("position").select("d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(table(spark, sf_dir, "documents"))
