"""The mixture reaches the pipeline's result, whatever order files are read in."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from ledgerloom.llm import mixing
from tests.llm.conftest import SCHEMA
from tests.llm.test_layout_operators import brute_mix


def wanted(counts):
    counts, out = Counter(counts), []
    for source in brute_mix(counts, mixing.WEIGHTS, mixing.BLOCK):
        size = min(mixing.BLOCK, counts[source])
        counts[source] -= size
        out += [source] * size
    return out


def in_order(found):
    rows = sorted(found.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(rows)))
    return [r["source"] for r in rows]


def test_files_of_unequal_size(spark, tmp_path):
    """Long documents of the source that lasts longest make the last files the largest, which are read first."""
    rows = [(i, f"{i} word" * (400 if i > 500 else 1), "en", "src0" if i > 300 else f"src{i % 3}", 0) for i in range(700)]
    corpus_pipeline.mixed(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "").write.option("maxRecordsPerFile", 60).parquet(str(tmp_path / "mixed"))
    docs = spark.read.parquet(str(tmp_path / "mixed"))
    want = wanted(Counter(r[3] for r in rows))
    assert [r["source"] for r in docs.select("source").collect()] != want  # the order read is not that of the mixture
    corpus_pipeline.tokens(spark, docs, "").write.parquet(str(tmp_path / "tokens"))
    assert in_order(spark.read.parquet(str(tmp_path / "tokens"))) == want


def test_run_keeps_the_shares(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    order = in_order(found)
    assert order == wanted(Counter(order))


def test_no_documents(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "none"))
    assert corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "none")), "").count() == 0
