"""Very long runs of white space: the splitter's stack does not bound them."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

import corpus_pipeline
from ledgerloom.llm import bpe, chat
from tests.llm.conftest import SCHEMA

WHITE = "\t\n\x0b\x0c\r \x85\xa0        　"
LONG = 2_000_000


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(public_tokenizers.path(bpe.RANKS))


@pytest.mark.parametrize("size", [bpe.PIECE_CHARS, 50])
def test_runs_as_the_tokenizer_itself_does(enc, monkeypatch, size):
    rng = random.Random(6)
    monkeypatch.setattr(bpe, "_RUN", bpe.regex.compile(bpe._RUN.pattern.replace("{4096,}", "{3,}")))
    monkeypatch.setattr(bpe, "RUN_CHARS", 3)
    for kind in (" ", "\n", " \n", WHITE):
        for _ in range(60):
            run = lambda: "".join(rng.choice(kind) for _ in range(rng.choice((1, 2, 3, 4, 9, 200))))  # noqa: E731, B023
            text = "".join(rng.choice((run(), "a", "don't", "12", "é漢", "!?", "\x1c\x1f", "​", "word")) for _ in range(30))
            assert bpe.encode_text(enc, text, size) == enc.encode_ordinary(text)


@pytest.mark.parametrize("run", [" " * LONG, "\n" * LONG, " \n\t\xa0" * (LONG // 4)], ids=["spaces", "feeds", "mixed"])
def test_two_million(enc, run):
    single = enc._encode_single_piece
    tail = lambda text: enc.encode_ordinary(run[-1] + text)
    want = {
        run: single(run),
        "a" + run: enc.encode_ordinary("a") + single(run),
        run + "b": single(run[:-1]) + tail("b"),
        "a" + run + "!b": enc.encode_ordinary("a") + single(run[:-1]) + tail("!b"),
        run + "a" + run: single(run[:-1]) + tail("a") + single(run),
    }
    for text, ids in want.items():
        assert bpe.encode_text(enc, text) == ids
        assert enc.decode_bytes(ids).decode() == text


def test_operators(spark, tmp_path):
    run = " \n" * (LONG // 2)
    texts = {1: run, 2: "a" + run + "b", 3: "\n" * LONG + "word"}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(bpe.RANKS), decoded="back").select("doc_id", "back").collect()
    assert {r.doc_id: bytes(r.back).decode() for r in coded} == texts
    docs.coalesce(1).write.parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), "").select("doc_id", "n_tokens").collect()
    assert {r.doc_id for r in out} == set(texts) and all(r.n_tokens > 1000 for r in out)
    turns = spark.createDataFrame([(1, 0, "user", run), (1, 1, "assistant", "yes" + run)], "conv_id long, turn int, role string, text string")
    found = chat.read_back(chat.format_windows(turns, public_tokenizers.path(bpe.RANKS))).first()
    assert found.n_turns == 2 and found.loss_chars == len("yes" + run)
