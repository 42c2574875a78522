"""Byte-level BPE: encoding by a local rank file and raw-byte decoding.

Long texts are cut at *safe boundaries* before the tokenizer sees them: places where the splitting
pattern always ends a match, so the pieces' tokens are the text's tokens. A space or line feed after a
letter, digit or mark is such a place, because no match of the pattern holds a non-space followed by
white space; and so is a change between letters and digits, because no match holds both.
A stretch without any safe boundary (one endless word) stays whole.

The pattern makes one match of a run of white space, but for its last character when more text follows;
looking ahead for that, the tokenizer's splitter needs stack for every character. Runs of ``RUN_CHARS``
and more are therefore taken out of the text, and their match goes to the encoder by itself.

Defined results: a null text counts as empty, an empty text has no tokens, ids of a null array decode
to no bytes. Repeated rows are encoded like any other. Only the named columns are read; other columns
pass through, and an output name that is already taken is replaced.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import table, values

RANKS = "byte_bpe_multi_50k.tiktoken"

#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 32_768
#: White space in a row that is encoded by itself.
RUN_CHARS = 4_096
#: Rows whose tokens are held at once.
ROWS = 256

#: Only characters on whose class all versions of Unicode agree decide a cut.
_SAFE = regex.compile(r"(?<=[\p{L}0-9!-/:-@\[-`{-~])(?=[ \n])|(?<=\p{L})(?=[0-9])|(?<=[0-9])(?=\p{L})")
#: The characters that the splitter takes for white space: Unicode's property White_Space.
_RUN = regex.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN_CHARS},}}")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of ``size`` characters or a little more."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(enc: tiktoken.Encoding, text: str | None, size: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= min(size, RUN_CHARS):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))  # the last character belongs to what follows
        out += _encode_rest(enc, text[at : run.start()], size)
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + _encode_rest(enc, text[at:] if at else text, size)


def _encode_rest(enc: tiktoken.Encoding, text: str, size: int) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, size) for i in enc.encode_ordinary(piece)]


def _listed(rows: Iterator[list[int]]) -> pa.Array:
    """Token ids as an Arrow list column, held as 32-bit numbers from the start."""
    flat, ends = array("i"), [0]
    for ids in rows:
        flat.extend(ids)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32), pa.int32()))


def _coded(df: DataFrame, source: str, outputs: dict[str, T.DataType], make) -> DataFrame:
    """``df`` with the columns ``outputs``, which ``make`` gives from a piece of ``source``, over Arrow batches."""
    taken = {c.lower() for c in outputs}
    schema = T.StructType([*(f for f in df.schema if f.name.lower() not in taken), *(T.StructField(c, k) for c, k in outputs.items())])
    kept = [f.name for f in schema][: -len(outputs)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                cut = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(cut.column(n) for n in kept), *make(cut.column(source))], [*kept, *outputs])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks: str, text: str = "text", ids: str = "ids", decoded: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``ids``, the token ids of ``text`` under the rank file ``ranks``; every node needs the file.

    With ``decoded``, also adds the bytes that the ids decode to, in the same pass.
    """

    def make(column: pa.Array) -> list[pa.Array]:
        enc = encoding(ranks, pattern)
        out = _listed(encode_text(enc, t) for t in values(column))
        return [out, _bytes(enc, out)] if decoded else [out]

    outputs = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.BinaryType()} if decoded else {})
    return _coded(df, text, outputs, make)


def decode(df: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``out``, the raw bytes that ``ids`` stand for. Bytes need not be UTF-8, so they stay binary."""
    return _coded(df, ids, {out: T.BinaryType()}, lambda column: [_bytes(encoding(ranks, pattern), column)])


def _bytes(enc: tiktoken.Encoding, ids: pa.Array) -> pa.Array:
    return pa.array((enc.decode_bytes(x) if x else b"" for x in values(ids)), pa.binary())


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """One row per document: number of tokens, and digests of the ids and of the bytes they decode to."""
    coded = encode(docs.select("doc_id", "text"), ranks, decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
