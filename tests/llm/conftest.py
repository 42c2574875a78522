from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EN = "the quick brown fox jumps over the lazy dog and then the other fox sleeps near the river with a friend"
DE = "der schnelle braune fuchs springt über den faulen hund und schläft dann mit einem freund an dem fluss"


def rows():
    """Nulls in every column, empty and odd texts, ties, repeated rows and a long text."""
    out = [
        (1, EN, "en", "a", len(EN)),
        (2, EN.upper(), "en", "a", 1),
        (3, EN + " today", "en", None, 2),
        (3, EN + " today", "en", None, 2),
        (4, DE, "de", "b", None),
        (5, None, None, "b", None),
        (6, "", "en", "a", 0),
        (None, "  \t\n ", None, None, None),
        (None, DE, "de", "b", 3),
        (7, "12345 !!! \x00", "en", "c", 4),
        (8, "Ünïcödé 漢字 \U0001f600 don't stop 's", "de", "c", 5),
        (9, (EN + " ") * 400 + "x" * 70_000, "en", "a", 6),
        (10, "Licensed under the Apache License, Version 2.0.\n" + EN, "en", "a", 7),
        (11, "one two", "en", "a", 8),
    ]
    return out + [(100 + i, f"{EN} number {i % 7}", "en", "hot", i) for i in range(60)] + [(200 + i, f"{DE} nummer {i}", "de", "b", i) for i in range(20)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "h key row ids decoded fp shard slot position block d n i bucket lang_pred score labels phases s p k _part _n at".split()
    return docs.withColumns({n: F.lit("taken") for n in names}).withColumn("extra", F.struct(F.lit(1).alias("n")))
