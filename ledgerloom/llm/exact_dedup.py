"""Exact deduplication with an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. Four steps:

1. *Keys.* Every row is reduced to (doc_id, 64-bit key, digest, length) and written to the shared
   folder; texts are not kept.
2. *Directory.* Bucket sizes are counted by key prefix. The driver starts with one bucket and splits
   whatever is overfull; a split that needs more prefix bits than the directory has doubles the
   directory. It holds bucket sizes only, ``2 ** max_depth`` entries at most.
3. *Owners.* Each bucket — a range of keys — goes to one owner task. Map tasks first fold the copies
   that they see themselves, so that a text repeated a million times arrives once per task. An owner
   walks its keys in order, chains texts whose keys collide and compares their bytes. The index in the
   shared folder gets one entry per distinct text, with the row that stays.
4. *Look-up.* The rows of step 1 join the index on (key, digest).

Defined results: a null text counts as empty; null doc_ids are the smallest; of rows that share the
largest doc_id and the text exactly one stays; empty tables give empty results. Extra columns are not
read by ``index`` and pass through ``dedup``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.common import batches_of, keep_rows, stage, table, values

#: A bucket splits beyond so many distinct texts or so many bytes of them.
BUCKET_TEXTS, BUCKET_BYTES = 50_000, 32 << 20
MAX_DEPTH = 16
#: A map task folds copies within this many bytes of text at a time.
FOLD_BYTES = 16 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _norm(text: str | None) -> bytes:
    return (text or "").encode().lower()  # on bytes, lower() changes A-Z only


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, h, sha, bytes) of every row; ``h`` is common.row_hash of the text as it stands."""
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("sha", pa.binary()), ("bytes", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for text in values(batch.column("text")):
                norm = _norm(text)
                key, raw = xxhash.xxh64_intdigest(norm, 42), xxhash.xxh64_intdigest((text or "").encode(), 42)
                rows.append((_signed(key), _signed(raw), hashlib.sha256(norm).digest(), len(norm)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, h long, sha binary, bytes long")


def directory(sizes: dict[int, tuple[int, int]], texts: int = BUCKET_TEXTS, size: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Global depth and, for each key prefix of that many bits, the bucket that holds it.

    ``sizes``: texts and bytes by prefix of ``max_depth`` bits. A bucket is numbered by its place in
    key order; buckets of a smaller local depth own several neighbouring prefixes.
    """
    leaves: list[tuple[int, int]] = []  # (prefix, local depth)
    todo = [(0, 0, list(sizes.items()))]
    while todo:
        prefix, local, inside = todo.pop()
        if local < max_depth and (sum(n for _, (n, _) in inside) > texts or sum(b for _, (_, b) in inside) > size):
            bit = max_depth - local - 1
            for side in (1, 0):
                todo.append((prefix * 2 + side, local + 1, [x for x in inside if x[0] >> bit & 1 == side]))
        else:
            leaves.append((prefix, local))
    depth = max(local for _, local in leaves)
    entries = [bucket for bucket, (_, local) in enumerate(leaves) for _ in range(1 << (depth - local))]
    return depth, entries


def _better(a: tuple, b: tuple) -> tuple:
    """The row that stays, of two given as (has a doc_id, doc_id, h)."""
    return b if (b[0], b[1] if b[0] else 0, b[2]) > (a[0], a[1] if a[0] else 0, a[2]) else a


def _folded(docs: DataFrame, depth: int, entries: list[int]) -> DataFrame:
    """(bucket, key, norm, n, keep_id, keep_h) with the copies inside each stretch of a map task folded; keeps no more than FOLD_BYTES."""
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("norm", pa.binary()), ("n", pa.int64()), ("keep_id", to_arrow_type(kind)), ("keep_h", pa.int64())])

    def entry(norm: bytes, n: int, best: tuple) -> tuple:
        key = xxhash.xxh64_intdigest(norm, 42)
        return entries[key >> (64 - depth)], _signed(key), norm, n, best[1], best[2]

    def rows(batches) -> Iterator[tuple]:
        seen: dict[bytes, tuple[int, tuple]] = {}
        held = 0
        for batch in batches:
            for doc_id, text in zip(values(batch.column("doc_id")), values(batch.column("text")), strict=True):
                norm = _norm(text)
                own = (doc_id is not None, doc_id, _signed(xxhash.xxh64_intdigest((text or "").encode(), 42)))
                if norm in seen:
                    n, best = seen[norm]
                    seen[norm] = n + 1, _better(best, own)
                else:
                    held += len(norm)
                    seen[norm] = 1, own
                if held > FOLD_BYTES:
                    yield from (entry(x, *v) for x, v in seen.items())
                    seen, held = {}, 0
        yield from (entry(x, *v) for x, v in seen.items())

    return docs.select("doc_id", "text").mapInArrow(lambda batches: batches_of(rows(batches), schema), f"bucket int, key long, norm binary, n long, keep_id {kind.simpleString()}, keep_h long")


def _owned(texts: DataFrame) -> DataFrame:
    """Index entries of the buckets of a task, whose rows come ordered by (bucket, key): digest, copies and the row that stays."""
    if "keep_id" not in texts.columns:  # entries of no row in particular
        texts = texts.select("*", *[F.lit(None).cast("long").alias(c) for c in ("keep_id", "keep_h")])
    kind = texts.schema["keep_id"].dataType
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.binary()), ("n", pa.int64()), ("keep_id", to_arrow_type(kind)), ("keep_h", pa.int64())])

    def each(batches):
        for batch in batches:
            yield from zip(*(values(batch.column(c)) for c in ("bucket", "key", "norm", "n", "keep_id", "keep_h")), strict=True)

    def rows(batches) -> Iterator[tuple]:
        for (bucket, key), found in groupby(each(batches), key=lambda r: r[:2]):
            chain: dict[bytes, tuple[int, tuple]] = {}  # looking a text up compares its bytes with those of the chain
            for _, _, norm, n, keep_id, keep_h in found:
                own = (keep_id is not None, keep_id, keep_h)
                count, best = chain.get(norm, (0, own))
                chain[norm] = count + n, _better(best, own)
            digests = [hashlib.sha256(norm).digest() for norm in chain]
            if len(set(digests)) < len(digests):
                raise ValueError("two different texts share a key and a SHA-256 digest")
            for place, (sha, (n, best)) in enumerate(zip(digests, chain.values(), strict=True)):
                yield bucket, key, place, sha, n, best[1], best[2]

    return texts.mapInArrow(lambda batches: batches_of(rows(batches), schema), f"bucket int, key long, chain int, sha binary, n long, keep_id {kind.simpleString()}, keep_h long")


def build(docs: DataFrame, texts: int = BUCKET_TEXTS, size: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """The keyed rows and the index entries, both as tables in the shared folder."""
    rows = stage(_keyed(docs).withColumn("row", F.monotonically_increasing_id()), "dedup-keys")
    prefix = F.shiftrightunsigned("key", 64 - max_depth).cast("int")
    counted = rows.groupBy("key", "sha").agg(F.max("bytes").alias("b")).groupBy(prefix.alias("p")).agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    depth, entries = directory({r["p"]: (r["n"], r["b"]) for r in counted.collect()}, texts, size, max_depth)
    owners = entries[-1] + 1
    dealt = _folded(docs, depth, entries).repartitionById(owners, F.col("bucket")).sortWithinPartitions("bucket", "key")
    return rows, stage(_owned(dealt), "dedup-index")


def index(docs: DataFrame, texts: int = BUCKET_TEXTS, size: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: doc_id, h, keep_id, group_size, kept, sha, row and the alike rows' count ``n``."""
    rows, entries = build(docs, texts, size, max_depth)
    known = entries.select("key", "sha", F.col("n").alias("group_size"), "keep_id", "keep_h")
    found = rows.join(known, ["key", "sha"]).withColumn("best", F.expr("doc_id <=> keep_id AND h = keep_h"))
    # Rows alike in id and text are one to the index; the first of them stays.
    first = found.where("best").groupBy(F.col("key").alias("k"), F.col("sha").alias("s")).agg(F.min("row").alias("first"))
    first = stage(first.where("first IS NOT NULL").select("first"), "dedup-first")
    marked = found.join(first, F.col("row") == F.col("first"), "left")
    return marked.select("doc_id", "h", "sha", "row", "group_size", "keep_id", F.col("first").isNotNull().alias("kept"))


def dedup(docs: DataFrame, **limits) -> DataFrame:
    """The documents that stay, with their own columns."""
    found = stage(index(docs, **limits), "dedup-rows")
    kept = found.where("kept").select("doc_id", "h")
    alike = found.where("keep_id <=> doc_id").groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    return keep_rows(docs, kept.alias("k").join(alike.alias("a"), F.expr("k.doc_id <=> a.doc_id AND k.h = a.h")).select("k.doc_id", "k.h", "n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS x FROM documents),
     g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""
