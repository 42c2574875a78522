"""Source files: decoding to lines or cells, kind detection, deduplication, company matching."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import parse_amount, parse_day
from ledgerloom.session import stage
from ledgerloom.sources import scans

# Delimiters of exported lists, preferred ones first.
DELIMITERS = (";", "\t", ",", "|")
# Byte order marks and the encodings that they announce.
MARKS = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
# The letters of Swedish texts beyond ASCII, and the code pages that such texts come in.
LETTERS = "åäöÅÄÖéÉüÜ"
CODE_PAGES = ("cp1252", "cp437")
#: Bytes of a file's head that its kind is judged from first.
SNIFF = 8192


def encoding_of(raw: bytes) -> str:
    """The announced encoding, UTF-8 where the bytes are valid, else the code page whose Swedish letters they hold most."""
    for mark, name in MARKS.items():
        if raw[: len(mark)] == mark:
            return name
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    votes = {page: int(counts[list(LETTERS.encode(page))].sum()) for page in CODE_PAGES}
    if votes["cp437"] == votes["cp1252"]:
        return "cp437" if b"#FORMAT PC8" in raw.upper() else "cp1252"
    return max(votes, key=votes.get)


def decode(raw: bytes) -> str:
    return raw.decode(encoding_of(raw), errors="replace")


def delimiters(lines: DataFrame) -> DataFrame:
    """(file, delimiter): the one that gives the most lines of a file the same number of columns, and most columns.

    ``lines`` as ``to_lines`` gives them; all of them count. Delimiters inside quotes do not.
    """
    bare = F.regexp_replace("line", '"[^"]*"', "")
    width = lambda d: (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("width")
    votes = lines.select("file", F.explode(F.array(*[F.struct(F.lit(-k).alias("rank"), width(d)) for k, d in enumerate(DELIMITERS)])).alias("v"))
    lengths = votes.where("v.width > 0").groupBy("file", "v.rank", "v.width").agg(F.count("*").alias("n"))
    best = lengths.groupBy("file").agg(F.max(F.struct("n", "width", "rank")).alias("best"))
    return best.select("file", F.element_at(F.array(*map(F.lit, DELIMITERS)), 1 - F.col("best.rank")).alias("delimiter"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a folder (path, content) with kind and hash; no file is left out.

    Files beyond what Spark reads as one value (2 GiB) fail the job.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("file"), "content", F.col("modificationTime").alias("arrived_at"))
    )
    return with_kind(raw)


def with_kind(files: DataFrame) -> DataFrame:
    """Adds source_kind — ``sie``, ``json``, ``csv`` or ``unsupported`` — and sha256.

    The first ``SNIFF`` bytes decide if they show a kind; what is left is looked through to its end
    for SIE records.
    """
    start = F.hex(F.substring(F.col("content"), 1, 4))
    wide = start.startswith("FFFE") | start.startswith("FEFF")
    read = lambda c: F.regexp_replace(F.when(wide, F.decode(c, "UTF-16")).otherwise(F.decode(c, "ISO-8859-1")), "^(\ufeff|ï»¿)?\\s*", "")
    head = F.substring(F.col("content"), 1, SNIFF)
    binary = start.startswith("504B0304") | start.startswith("D0CF11E0") | start.startswith("25504446")
    # UTF-16 text has zero bytes too; its byte order mark tells it apart from binary files.
    zeros = F.contains(F.hex(head), F.lit("0000")) & ~wide
    record = r"(?m)^\s*#(FLAGGA|PROGRAM|FORMAT|GEN|SIETYP|FNAMN|RAR|KONTO|VER)\b"
    kind = (
        F.when(binary | zeros, "unsupported")
        .when(read(head).startswith("{"), "json")
        .when(F.upper(read(head)).rlike(record), "sie")
        .when(F.lower("file").rlike(r"\.(se|si|sie)$"), "sie")
        .when((F.length("content") > SNIFF) & F.upper(read(F.col("content"))).rlike(record), "sie")
        .otherwise("csv")
    )
    return files.withColumn("source_kind", kind).withColumn("sha256", F.sha2("content", 256))


def to_lines(files: DataFrame) -> DataFrame:
    """One row per text line: file, line_no, line. Decoding is the only Python step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                lines = decode(bytes(content)).splitlines()
                for lo in range(0, len(lines), 50_000):
                    part = lines[lo : lo + 50_000]
                    yield pd.DataFrame({"file": file, "line_no": range(lo + 1, lo + len(part) + 1), "line": part})

    return files.select("file", "content").mapInPandas(run, "file string, line_no int, line string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per text line of a folder's files: file, line_no, line. Files are read in splits, whatever their size.

    Lines end with a line feed, a carriage return or both. A line's number is the number of lines in earlier
    splits and its place in its own. The encoding of a file is chosen from all its lines, as ``encoding_of`` does.
    UTF-16 files cannot be split by bytes; they are read whole.
    """
    bounds = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = bounds.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").cast("binary").alias("raw"),
    )
    raw = stage(raw, "text_lines")
    counts = raw.groupBy("file", "at").agg(F.count("*").alias("n"))
    offsets = counts.select("file", "at", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from"))
    # splits are bounded; rows of a split were written in their order
    inside = F.row_number().over(Window.partitionBy("file", "at").orderBy("row"))
    placed = raw.withColumn("i", inside).join(offsets, ["file", "at"]).select("file", (F.col("from") + F.col("i")).cast("int").alias("line_no"), "raw")
    kinds = stage(encodings(raw), "text_encodings")
    named = placed.join(kinds.where("encoding <> 'utf-16'"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [raw.as_py().decode(name.as_py(), errors="replace") for raw, name in zip(batch.column("raw"), batch.column("encoding"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("line_no"), pa.array(lines, pa.string())], ["file", "line_no", "line"])

    split = named.mapInArrow(run, "file string, line_no int, line string")
    wide = kinds.where("encoding = 'utf-16'").select("file")
    if wide.isEmpty():
        return split
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(f"length < {1 << 31}")
    return split.unionByName(to_lines(whole.select(F.col("_metadata.file_path").alias("file"), "content").join(wide, "file", "left_semi")))


def encodings(raw: DataFrame) -> DataFrame:
    """(file, encoding) from all lines (file, at, row, raw bytes) of each file; ``at`` 0 and the least row hold its first line."""
    latin = F.decode("raw", "ISO-8859-1")
    votes = lambda page: F.sum(F.length(latin) - F.length(F.translate(latin, bytes(LETTERS.encode(page)).decode("latin-1"), "")))
    heads = F.min_by(F.hex(F.substring("raw", 1, 3)), F.struct("at", "row"))
    seen = raw.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"),
        *[votes(page).alias(page) for page in CODE_PAGES],
        F.bool_or(F.upper(latin).contains("#FORMAT PC8")).alias("pc8"),
        heads.alias("head"),
    )
    marked = F.when(F.col("head").startswith("FFFE") | F.col("head").startswith("FEFF"), "utf-16").when(F.col("head") == "EFBBBF", "utf-8-sig")
    first, second = CODE_PAGES
    page = F.when(F.col(first) == F.col(second), F.when(F.col("pc8"), second).otherwise(first)).when(F.col(first) > F.col(second), first).otherwise(second)
    return seen.select("file", F.coalesce(marked, F.when(F.col("utf8"), "utf-8"), page).alias("encoding"))


def quote_state(line: str, delimiter: str) -> tuple[bool, bool]:
    """Whether a quoted field is open after a line that began outside one, and after one that began inside one."""
    out = []
    for inside in (False, True):
        start, i = not inside, 0  # ``start``: at the first character of a field
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        inside = False
            elif c == delimiter:
                start, i = True, i + 1
                continue
            elif c == '"' and start:
                inside = True
            start, i = False, i + 1
        out.append(inside)
    return out[0], out[1]


def line_cells(lines: DataFrame) -> DataFrame:
    """One row per record of delimited lines, with all its columns: file, line_no of its first line, cells.

    A quoted field may go on over several lines. Each line is summed up by what it does to an open or closed
    quote; these compose along the file, so that a line knows its own state without its file being read in order.
    """
    told = lines.join(delimiters(lines), "file", "left").withColumn("delimiter", F.coalesce("delimiter", F.lit(DELIMITERS[0])))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [quote_state(x, d) if '"' in (x := line.as_py() or "") else (False, True) for line, d in zip(batch.column("line"), batch.column("delimiter").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in ends]), pa.array([o for _, o in ends])], [*batch.schema.names, "closed", "opened"])

    told = stage(told.mapInArrow(states, "file string, line_no int, line string, delimiter string, closed boolean, opened boolean"), "quote_states")
    # a line sets the state, keeps it, or turns it over
    turned = scans.running_sum(told, F.when(F.col("closed") & ~F.col("opened"), 1), "turns", before=True)
    fixed = F.when(F.col("closed") == F.col("opened"), F.struct(F.col("closed").alias("value"), F.col("turns").alias("turns")))
    known = scans.last_known(turned, fixed, "fixed", before=True)
    inside = F.coalesce(F.col("fixed.value").cast("int"), F.lit(0)) + F.col("turns") - F.coalesce("fixed.turns", F.lit(0))
    begun = scans.last_known(known.withColumn("starts", inside % 2 == 0), F.when(F.col("starts"), F.col("line_no")), "record")
    begun = stage(begun.select("file", "line_no", "record", "line", "delimiter"), "quote_records")
    longer = begun.where("line_no > record").select("file", "record").distinct()
    single = begun.join(longer, ["file", "record"], "left_anti").select("file", "line_no", "delimiter", F.array("line").alias("lines"))
    packed = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    several = begun.join(longer, ["file", "record"], "left_semi").groupBy("file", F.col("record").alias("line_no")).agg(F.first("delimiter").alias("delimiter"), F.transform(packed, lambda x: x["line"]).alias("lines"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [next(csv.reader(held, delimiter=d), []) for held, d in zip(batch.column("lines").to_pylist(), batch.column("delimiter").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("line_no"), pa.array(rows, pa.list_(pa.string()))], ["file", "line_no", "cells"])

    return single.unionByName(several).mapInArrow(cells, "file string, line_no int, cells array<string>")


def to_cells(files: DataFrame) -> DataFrame:
    """One row per record of a delimited file, with all its columns: file, line_no, cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content, delimiter in zip(batch["file"], batch["content"], batch["delimiter"], strict=True):
                records = enumerate(csv.reader(decode(bytes(content)).splitlines(), delimiter=delimiter or DELIMITERS[0]), 1)
                while part := list(islice(records, 50_000)):
                    yield pd.DataFrame({"file": file, "line_no": [n for n, _ in part], "cells": [cells for _, cells in part]})

    chosen = files.select("file", "content").join(delimiters(to_lines(files)), "file", "left")
    return chosen.mapInPandas(run, "file string, line_no int, cells array<string>")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content the company has not imported before; one copy of equal files."""
    fresh = files.join(known.select("company_id", "sha256"), ["company_id", "sha256"], "left_anti")
    first = fresh.groupBy("company_id", "sha256").agg(F.min("file").alias("file"))
    return fresh.join(first, ["company_id", "sha256", "file"], "left_semi")


def match_companies(files: DataFrame, companies: DataFrame, known: DataFrame) -> DataFrame:
    """Bulk import: each file's company by the digits of its org number, and what happens to it.

    ``files``: file, sha256, org_number, readable. Status: imported, duplicate, no_match or error.
    """
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    keyed = companies.select("company_id", digits(F.col("org_number")).alias("org")).where("org <> ''")
    seen = known.select("company_id", "sha256", F.lit(True).alias("seen")).distinct()
    j = files.withColumn("org", digits(F.col("org_number"))).join(keyed, "org", "left").join(seen, ["company_id", "sha256"], "left")
    status = (
        F.when(~F.col("readable"), "error").when(F.col("company_id").isNull(), "no_match").when(F.col("seen"), "duplicate").otherwise("imported")
    )
    return j.select("file", "sha256", "company_id", "org_number", status.alias("status"))


def tax_account_statement(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    """Tax-account export: columns found by header, rows that cannot be read are skipped."""
    raw = spark.read.option("header", "true").option("sep", delimiter).csv(path)

    def find(*names: str) -> str:
        for col in raw.columns:
            if any(n in col.strip().lower() for n in names):
                return col
        raise ValueError(f"no column for {names}")

    day, text, amount = find("datum", "date"), find("text", "specifikation", "transaktion"), find("belopp", "amount")
    rows = raw.select(
        parse_day(F.substring(F.trim(F.col(f"`{day}`")), 1, 10)).alias("date"),
        F.trim(F.col(f"`{text}`")).alias("text"),
        parse_amount(F.col(f"`{amount}`")).alias("amount"),
    )
    return rows.where("date IS NOT NULL AND amount IS NOT NULL")
