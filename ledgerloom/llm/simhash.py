"""SimHash near-duplicates by exact tiled comparison.

A document's fingerprint has one bit per position that is set in more than half of the hashes of its
word shingles. Fingerprints that differ in at most ``radius`` bits are linked, and linked documents
form groups. All pairs of different fingerprints are covered, in tiles:

* The population counts of the fingerprint's four 16-bit words are its *tile*. Each differing bit
  changes one of the counts by one, so tiles whose counts differ by more than ``radius`` in sum hold
  no link and are skipped; with radius 2 a tile meets 41 of up to 83,521 others.
* Large tiles are cut into blocks of about ``BLOCK`` fingerprints. A pair of blocks is compared with
  exclusive-or and bit counts in numpy, and yields the spanning stars of its links: at most one
  edge per fingerprint, not one per pair, however dense the block is.
* Stars are joined to groups by ``components``.

Defined results: null, empty and white-space texts have no words and the fingerprint zero, which links
like any other; documents with fewer words than a shingle are one shingle; equal fingerprints are
always one group; null doc_ids never name a group that has another id. Extra columns are not read by
``groups`` and pass through ``dedup``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import batches_of, keep_rows, row_hash, stage, table, values
from ledgerloom.llm.components import components

#: Production parameters: words in a shingle, hash seed, bits that linked fingerprints may differ in.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a block; shingles hashed at a time.
BLOCK, CHUNK = 2048, 1 << 15


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first."""
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text; hashes are counted in chunks, so memory does not grow with them."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    shingle = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        total += _bits([digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)])
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, h, fp) of every row: h is common.row_hash, fp the fingerprint as a signed bigint."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in values(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found, pa.int64())], ["doc_id", "h", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_hash(F.col("text")).alias("h")).mapInArrow(run, f"doc_id {kind}, h long, fp long")


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Gives all nodes that the links u-v connect the least label among them."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if not len(u):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(after := label[label], label):
            label[:] = after


def stars(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Edges that connect what the links between blocks ``a`` and ``b`` connect (``b`` None: inside ``a``)."""
    nodes, other, shift = (a, a, 0) if b is None else (np.concatenate([a, b]), b, len(a))
    label, linked = np.arange(len(nodes)), False
    for at in range(0, len(a), rows):
        u, v = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ other[None, :]) <= radius)
        u, v = u + at, v + shift
        if b is None:
            u, v = u[u < v], v[u < v]
        if len(u):
            linked = True
            _merge(label, u, v)
    if linked:
        moved = np.nonzero(label != np.arange(len(nodes)))[0]
        signed = nodes.view(np.int64)
        yield from zip(signed[moved].tolist(), signed[label[moved]].tolist(), strict=True)


def _near(radius: int) -> list[list[int]]:
    """Differences of the four counts that may hold links, one of each opposite pair."""
    span = range(-radius, radius + 1)
    return [list(d) for d in itertools.product(span, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) whose components are those of all links between the distinct fingerprints ``fps.fp``."""
    counts = F.array(*[F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)).cast("int") for k in range(4)])
    tiled = fps.select("fp", counts.alias("tile"))
    blocks = tiled.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    packed = tiled.join(blocks, "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    packed = packed.repartition("tile", "block")  # the join has left the rows of a tile in one task
    packed = stage(packed.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    left = packed.select("block", "fps", "tile", F.explode(F.lit(_near(radius))).alias("d"))
    left = left.select(F.col("block").alias("block_a"), F.col("fps").alias("a"), F.zip_with("tile", "d", lambda x, y: x + y).alias("tile"), (F.array_max("d") == 0).alias("own"))
    pairs = left.join(packed, "tile").where("NOT own OR block_a <= block")
    pairs = pairs.select("a", F.when(~(F.col("own") & (F.col("block_a") == F.col("block"))), F.col("fps")).alias("b"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            for k in range(batch.num_rows):
                one = a[k].values.to_numpy().view(np.uint64)
                two = b[k].values.to_numpy().view(np.uint64) if b[k].is_valid else None
                yield from stars(one, two, radius)

    return pairs.mapInArrow(lambda batches: batches_of(rows(batches), schema, max_rows=65_536), "u long, v long")


def groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, h, fp, component_id and best_h, the hash of the text of the group's first row."""
    rows = stage(fingerprints(docs, shingle, seed), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "h")).alias("first")
    distinct = stage(rows.groupBy("fp").agg(first), "simhash-fps")
    roots = components(links(distinct.select("fp"), radius))
    known = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("best"))
    known = stage(known.join(least, "root").select("fp", "best"), "simhash-groups")
    return rows.join(known, "fp").select("doc_id", "h", "fp", F.col("best.doc_id").alias("component_id"), F.col("best.h").alias("best_h"))


def dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with its own columns."""
    found = groups(docs, radius, shingle, seed).where("doc_id <=> component_id AND h = best_h")
    return keep_rows(docs, stage(found.groupBy("doc_id", "h").agg(F.count("*").alias("n")), "simhash-kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
