"""Sharding, mixing, search, chat windows and URL filter, against brute force over awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import public_tokenizers
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, chat, mixing, sharding, topk, url_filter
from tests.llm.conftest import rows

RANKS = public_tokenizers.path(bpe.RANKS)


# -- sharding


def test_shards_of_the_key_law(docs, no_docs, clashing):
    found = sharding.assign(clashing, sharding.tree(40), sharding.tree(41)).collect()
    assert len(found) == len(rows())
    sizes = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sizes
    assert all(r["grown_shard"] in (r["shard"], 40) for r in found)
    assert all(len({r["shard"] for r in found if r["doc_id"] == d}) == 1 for d in {r["doc_id"] for r in found})
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(no_docs, sharding.tree(40)).count() == 0


def test_shares_and_confined_movement(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    old = [[{0: 1.0, 1: 2.0}, {2: 1.0}], [{3: 3.0, 4: 1.0}]]
    new = [[{0: 1.0, 1: 2.0}, {2: 1.0}], [{3: 3.0, 4: 2.5}]]
    found = keys.select(sharding.shard_of(F.col("doc_id"), old).alias("a"), sharding.shard_of(F.col("doc_id"), new).alias("b"))
    moves = {(r["a"], r["b"]): r["n"] for r in found.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    share = Counter()
    for (a, _), n in moves.items():
        share[a] += n / 40_000
    for shard, weight in ((0, 1), (1, 2), (2, 1), (3, 3), (4, 1)):
        assert abs(share[shard] - weight / 8) < 0.012
    assert all(a == b or b in (3, 4) for a, b in moves)  # nothing moves among the shards of the other region
    counts = Counter()
    for n in (40, 41, 42, 43):  # each added shard takes rows only into itself
        step = keys.select(sharding.shard_of(F.col("doc_id"), sharding.tree(n)).alias("a"), sharding.shard_of(F.col("doc_id"), sharding.tree(n + 1)).alias("b"))
        assert all(r["b"] == n for r in step.where("a <> b").distinct().collect())
        counts[n] = step.where("a <> b").count() / 40_000
        assert abs(counts[n] - 1 / (n + 1)) < 0.006


# -- mixing


def test_rounds_deviate_by_less_than_one_block():
    rng = random.Random(3)
    for _ in range(200):
        weights = {f"s{i}": rng.randint(1, 9) for i in range(rng.randint(1, 7))}
        plan, total = mixing.one_round(weights), sum(weights.values())
        for s in weights:
            for t in range(1, total + 1):
                assert abs(plan[:t].count(s) - Fraction(weights[s] * t, total)) < 1


def brute_mix(counts, weights, block):
    """Slots by a slot-by-slot schedule that restarts whenever a source has run out."""
    left, out = {s: -(-n // block) for s, n in counts.items()}, []
    while any(left.values()):
        now = {s: weights.get(s, mixing.DEFAULT_WEIGHT) for s in left if left[s]}
        plan, t = mixing.one_round(now), 0
        while left[plan[t % len(plan)]]:
            left[plan[t % len(plan)]] -= 1
            out.append(plan[t % len(plan)])
            t += 1
    return out


def test_mix_positions(docs, no_docs):
    weights = {"a": 3, "hot": 5, None: 1}
    for block in (1, 4):
        found = mixing.positions(docs, weights, block).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows())
        assert sorted(r["position"] for r in found) == list(range(len(rows())))
        slots = {}
        for r in sorted(found, key=lambda r: r["position"]):
            assert slots.setdefault(r["slot"], r["source"]) == r["source"]
        assert [slots[t] for t in sorted(slots)] == brute_mix(Counter(r[3] for r in rows()), weights, block)
        assert [r["slot"] for r in sorted(found, key=lambda r: r["position"])] == sorted(r["slot"] for r in found)
    assert mixing.positions(no_docs).count() == 0


def test_mix_lays_documents_out_in_order(spark, clashing, tmp_path):
    out = mixing.mix(clashing, {"a": 3, "hot": 5}, 2)
    assert out.columns == clashing.columns
    out.write.parquet(str(tmp_path / "mix"))
    parts = sorted((tmp_path / "mix").glob("part-*"))
    order = [r["source"] for p in parts for r in spark.read.parquet(str(p)).select("source").collect()]
    want = brute_mix(Counter(r[3] for r in rows()), {"a": 3, "hot": 5}, 2)
    blocks, left = [], Counter(r[3] for r in rows())
    for s in want:
        size = min(2, left[s])
        left[s] -= size
        blocks += [s] * size
    assert order == blocks
    assert Counter(map(tuple, spark.read.parquet(str(tmp_path / "mix")).select("doc_id", "text").collect())) == Counter((r[0], r[1]) for r in rows())


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).count() == 0


# -- top-k


def brute_topk(vectors, every, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in good if i % every == 0}:
        scores = [(sum(a * b for a, b in zip(x, y, strict=True)), i) for j, x in good if j == q for i, y in good if i != q and len(x) == len(y)]
        out |= {(q, rank, i, s) for rank, (s, i) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:k], 1)}
    return out


def test_topk_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(300)]
    vectors += [(300 + i, list(vectors[7][1])) for i in range(40)]  # ties
    vectors += [(400, None), (410, [None] * 24), (420, [float("nan")] * 24), (None, [0.5] * 24), (430, []), (440, []), (450, [0.25] * 5), (451, [0.5] * 5), (460, [float("inf")] * 24)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("taken")).repartition(4)
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    found = {tuple(r) for r in topk.search(df, F.col("vec_id") % 10 == 0, 10).collect()}
    assert found == brute_topk(vectors, 10, 10)
    assert topk.search(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_topk_beyond_float_sums(spark):
    rng = random.Random(6)
    vectors = [(i, [rng.choice([-1, 1]) * rng.random() * 2.0**18 for _ in range(6)]) for i in range(30)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.search(df, F.col("vec_id") % 10 == 0, 3).collect()} == brute_topk(vectors, 10, 3)


# -- chat windows


def test_escape_is_reversible():
    rng = random.Random(8)
    parts = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "|", "end|>\n", "a"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not any(c in out for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_windows_keep_to_the_budget():
    rng = random.Random(9)
    for _ in range(200):
        turns = [("system", "S", 5)] * rng.randint(0, 1) + [(rng.choice(["user", "assistant"]), f"t{i}", rng.randint(1, 30)) for i in range(rng.randint(0, 25))]
        seen, targets = [], []
        found = list(chat.windows(iter(turns), 40, 15))
        for number, text, fresh_from, loss, tokens in found:
            fresh = list(chat.turns_of(text[fresh_from:]))
            assert tokens <= 40 or len(fresh) == 1 or number == 0 and turns[0][0] == "system" and len(fresh) == 2
            if turns[0][0] == "system":
                assert text.startswith("<|turn role=system|>\nS<|end|>\n")
            seen += fresh
            targets += [text[a:b] for a, b in loss]
        assert seen == [(r, t) for r, t, _ in turns]
        assert targets == [t for r, t, _ in turns if r == "assistant"]


def test_chat_round_trip(spark):
    rng = random.Random(10)
    given = [(c, t, rng.choice(["user", "assistant", "system", "odd|role\n"]), "".join(rng.choice(["word ", "</s>", "<|end|>\n", "é", "\\"]) for _ in range(rng.randint(0, 60)))) for c in range(20) for t in range(rng.randint(1, 12))]
    given += [(None, None, None, None), (None, 1, "assistant", None), (50, None, "assistant", "x"), (50, None, "assistant", "x"), (51, 0, "system", "alone")]
    given += [(60, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(400)]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("taken")).repartition(7)
    want = {}
    least = lambda x: (x is not None, x)
    for conv in {g[0] for g in given}:
        turns = sorted((g for g in given if g[0] == conv), key=lambda g: (least(g[1]), least(g[2]), least(g[3])))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        target = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
    formatted = chat.format_windows(df, RANKS, 200, 60)
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(formatted).collect()} == want
    assert formatted.where("conv_id = 60").count() > 10
    assert chat.read_back(chat.format_windows(df.limit(0), RANKS)).count() == 0


# -- URL filter


def test_rules_and_parts(spark):
    urls = {
        1: ("http://WWW.Example.net/en/x?q#f", "www.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("http://other.net/en/", "other.net", "/en/", "net/", "block"),
        3: ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        4: ("https://a.b.org/fr/9#x", "a.b.org", "/fr/9", "org/fr/", "allow"),
        5: ("http://xexample.com/de/1", "xexample.com", "/de/1", None, None),
        6: ("no scheme", "", "", None, None),
        7: (None, "", "", None, None),
        8: ("x://h?a/b", "h", "", None, None),
        9: ("http://net", "net", "", None, None),
        10: ("http://cheap-pills.example.com/en/9", "cheap-pills.example.com", "/en/9", None, "block"),
        11: ("http://www.library.example.com/en/9", "www.library.example.com", "/en/9", None, "allow"),
        12: ("a://b://c/d", "b:", "//c/d", None, None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in urls.items()] + [(1, urls[1][0])], "page_id long, url string").withColumn("host", F.lit("taken"))
    found = url_filter.judge(df).collect()
    assert len(found) == len(urls) + 1
    intercept, weights = url_filter.trained()
    for r in found:
        url, host, path, rule, verdict = urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert url is None or url_filter.parts(url) == (host, path)
        z = intercept + sum(weights[b] for b in url_filter.buckets(host, path))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
        assert r["verdict"] == (verdict or ("block" if z >= 0 else "allow"))
    assert url_filter.judge(df.limit(0)).count() == 0


def test_model_fits_its_table():
    intercept, weights = url_filter.trained()
    for url, block in url_filter.LABELLED:
        assert (intercept + sum(weights[b] for b in url_filter.buckets(*url_filter.parts(url))) >= 0) == bool(block)
