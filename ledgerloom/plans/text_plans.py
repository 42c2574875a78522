"""Registered queries over texts and landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.masking import mask, unmask
from ledgerloom.plans.book import Book


def pii_masking(book: Book) -> DataFrame:
    """Whole documents with personal data masked; ``same`` = unmasking restores the text."""
    docs = book.spark.read.parquet(f"{book.sf_dir}/documents.parquet").select("doc_id", "text")
    m = mask(docs, "text")
    return m.select(
        "doc_id",
        F.length("masked").alias("n_chars"),
        F.size("mapping").alias("n_tokens"),
        F.sha2("masked", 256).alias("masked_hash"),
        (unmask(F.col("masked"), F.col("mapping")) == F.col("text")).cast("int").alias("same"),
    )


QUERIES = {"pii_masking": pii_masking}
SQL: dict[str, str] = {}
