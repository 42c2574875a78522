"""The corpus pipeline, each stage against brute force on its own input."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from ledgerloom.llm import bpe, mixing
from tests.llm.test_layout_operators import brute_mix
from tests.llm.test_near_copies import brute
from tests.llm.test_text_operators import LOWER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home, out = tmp_path_factory.mktemp("corpus"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(home / name))
        docs = spark.read.parquet(str(home / name))
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_clean_documents_pass_language_id(stages):
    lost = set(ids(stages[0])) - set(ids(stages[1]))
    texts = {r["doc_id"]: r["text"] for r in stages[0].collect()}
    assert all(not any(c.isalpha() for c in texts[d] or "") for d in lost)


def test_exact_copies_go(stages):
    last = {}
    for r in stages[1].collect():
        key = (r["text"] or "").translate(LOWER)
        last[key] = max(r["doc_id"], last.get(key, -1))
    assert ids(stages[2]) == sorted(last.values())


def test_near_copies_go(stages):
    kept, _, _ = brute({r["doc_id"]: r["text"] for r in stages[2].collect()})
    assert ids(stages[3]) == sorted(kept)


def test_sources_are_mixed(spark, stages):
    assert ids(stages[4]) == ids(stages[3])
    names = sorted(stages[4].inputFiles())
    order = [r["source"] for name in names for r in spark.read.parquet(name).select("source").collect()]
    counts = Counter(order)
    want = []
    for source in brute_mix(counts, mixing.WEIGHTS, mixing.BLOCK):
        size = min(mixing.BLOCK, counts[source])
        counts[source] -= size
        want += [source] * size
    assert order == want


def test_tokens(stages):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    texts = {r["doc_id"]: r["text"] or "" for r in stages[4].collect()}
    found = stages[5].collect()
    assert sorted(texts) == sorted(r["doc_id"] for r in found)
    assert all(r["ids"] == enc.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in found)


def test_run_gives_the_same_documents(spark, stages):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(stages[5])
