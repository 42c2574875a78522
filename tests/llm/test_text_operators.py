"""Operators on texts, against brute force over awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, exact_dedup, language_id, license_scan, simhash
from ledgerloom.llm.components import components
from tests.llm.conftest import rows

RANKS = public_tokenizers.path(bpe.RANKS)
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def as_set(df):
    return Counter(map(tuple, df.collect()))


# -- byte-level BPE


def test_bpe_equals_whole_text_encoding():
    enc, rng = bpe.encoding(RANKS), random.Random(1)
    letters = "ab 's\n\t.!1２é漢\u3000'\x1c\x85  \u00a0"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        assert "".join(bpe.pieces(text, 16)) == text
        assert bpe.encode_text(enc, text, 16) == enc.encode_ordinary(text)


def test_bpe_digests(docs, no_docs):
    enc = bpe.encoding(RANKS)

    def want(doc_id, text):
        ids = enc.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert as_set(bpe.digests(docs, RANKS)) == Counter(want(r[0], r[1]) for r in rows())
    assert bpe.digests(no_docs, RANKS).count() == 0


def test_bpe_replaces_clashing_columns(clashing):
    out = bpe.decode(bpe.encode(clashing, RANKS), RANKS)
    assert sorted(out.columns) == sorted(clashing.columns)
    assert out.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0


def test_bpe_decodes_ids_that_are_not_text(spark):
    enc = bpe.encoding(RANKS)
    lone = enc.encode_single_token(b"\xff")
    df = spark.createDataFrame([(1, [lone]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r[0]: bytes(r[1]) for r in bpe.decode(df, RANKS).select("doc_id", "decoded").collect()} == {1: b"\xff", 2: b"", 3: b""}


# -- exact deduplication


def dedup_brute():
    groups = {}
    for doc_id, text, *_ in rows():
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    return groups


def test_exact_dedup(docs, no_docs, clashing):
    groups = dedup_brute()
    least = lambda d: -1 if d is None else d
    for limits in ({}, {"texts": 3, "size": 2000}):
        found = exact_dedup.index(docs, **limits).collect()
        want = Counter((d, max(ids, key=least), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["sha"]).hex()) for r in found) == want
        assert sum(r["kept"] for r in found) == len(groups)
    kept = exact_dedup.dedup(clashing)
    assert kept.columns == clashing.columns
    assert as_set(kept.select("doc_id")) == Counter((max(ids, key=least),) for ids in groups.values())
    assert exact_dedup.index(no_docs).count() == 0 and exact_dedup.dedup(no_docs).count() == 0


def test_directory_doubles_until_buckets_fit():
    rng = random.Random(2)
    sizes = {rng.randrange(1 << 16): (1, rng.randint(1, 50)) for _ in range(3000)} | {5: (4000, 9)}
    depth, entries = exact_dedup.directory(sizes, texts=100, size=10**9, max_depth=16)
    assert len(entries) == 1 << depth and entries == sorted(entries) and set(entries) == set(range(entries[-1] + 1))
    held, prefixes = Counter(), Counter()
    for p, (n, _) in sizes.items():
        held[entries[p >> (16 - depth)]] += n
        prefixes[entries[p >> (16 - depth)]] += 1
    assert all(n <= 100 or prefixes[b] == 1 for b, n in held.items())  # one overfull key cannot be split
    assert exact_dedup.directory({}) == (0, [0])


def test_chains_compare_bytes(spark):
    """Texts forced onto one key stay apart."""
    df = spark.createDataFrame([(0, 7, b"a", 1), (0, 7, b"b", 2), (0, 7, b"a", 3), (0, 9, b"c", 1)], "bucket int, key long, norm binary, n long")
    out = exact_dedup._owned(df.coalesce(1).sortWithinPartitions("bucket", "key")).collect()
    assert {(r["key"], bytes(r["sha"]), r["n"]) for r in out} == {(k, hashlib.sha256(t).digest(), n) for k, t, n in ((7, b"a", 4), (7, b"b", 2), (9, b"c", 1))}


# -- SimHash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_groups(docs, no_docs, clashing):
    ids, prints = [r[0] for r in rows()], [fingerprint(r[1]) for r in rows()]
    for radius in (2, 6):
        want = Counter(zip(ids, prints, brute_components(ids, prints, radius), strict=True))
        found = simhash.groups(docs, radius).collect()
        assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == want
    kept = simhash.dedup(clashing)
    assert kept.columns == clashing.columns
    assert as_set(kept.select("doc_id")) == Counter((d,) for d in {c for _, _, c in Counter(zip(ids, prints, brute_components(ids, prints, 2), strict=True))})
    assert simhash.groups(no_docs).count() == 0 and simhash.dedup(no_docs).count() == 0


def test_simhash_links_in_large_and_dense_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 2)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_components(signed, prints, 2)
    assert [found.get(s, s) for s in signed] == want


def test_stars_are_sparse():
    a = np.arange(256, dtype=np.uint64)
    assert len(list(simhash.stars(a, None, 2))) == 255


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(300, 400)] + [(7, 7), (8, 9), (9, 8)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 300 for i in [*range(300, 400), 1000]} | {8: 8, 9: 8}
    assert found == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- language identification


def test_gradients_match_differences():
    net = language_id.fresh(["a", "b", "c"], 4)
    net = language_id.Network(net.languages, *(p.astype(np.float64) for p in net.parts()))
    block, target = np.concatenate([language_id.windows(b"hello wor", 12), language_id.windows(b"abcabcabc", 12)]), np.array([1, 2])
    _, grads = language_id._gradients(net, block, target)
    for part, grad in zip(net.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), part.shape)
        part[at] += 1e-4
        up, _ = language_id._gradients(net, block, target)
        part[at] -= 2e-4
        down, _ = language_id._gradients(net, block, target)
        part[at] += 1e-4
        assert abs((up - down) / 2e-4 - grad[at]) < 2e-2 * abs(grad[at]) + 1e-4


def test_language_id_on_the_tables(spark):
    """Held-out accuracy on the given documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.train(language_id.sample(docs))
    found = language_id.predict(docs, net, keep=("doc_id", "lang")).where(language_id.held_out(F.col("doc_id")))
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97


def test_language_id_edges(docs, no_docs, clashing):
    net = language_id.train(language_id.sample(docs), epochs=30)
    found = language_id.predict(clashing, net, keep=("doc_id", "text", "extra"), pred="guess", score="sure").collect()
    assert len(found) == len(rows())
    for r in found:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["guess"] == "und" and r["sure"] == 0) if not lettered else r["guess"] in ("de", "en") and 0 < r["sure"] <= 1
    right = [r["guess"] == ("de" if "der" in r["text"].lower() else "en") for r in found if r["text"] and len(r["text"]) > 60]
    assert sum(right) / len(right) > 0.95
    assert language_id.train(language_id.sample(no_docs)) is None
    assert {tuple(r) for r in language_id.predict(docs, None).select("lang_pred", "score").collect()} == {("und", 0.0)}
    held = {r["doc_id"]: r["held"] for r in docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held")).collect()}
    assert all(v == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, v in held.items())


def test_language_sample_leaves_out_held_out_rows(docs):
    texts = {r[1] for r in rows() if r[1] and r[2] and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2)}
    assert all(any(piece in t.encode() for t in texts) for _, piece in language_id.sample(docs))


# -- licences


def test_license_scan_base_places():
    auto, rng = license_scan.automaton(), random.Random(5)
    phrases = [p.split() for _, p in (*license_scan.TEMPLATES, *license_scan.BASE)]
    vocabulary = sorted({w for p in phrases for w in p}) + ["foo", "x"]
    for _ in range(1500):
        text = []
        while len(text) < rng.randint(0, 40):
            p = rng.choice(phrases)
            at = rng.randrange(len(p))
            text += p[at : at + rng.randint(1, 12)] if rng.random() < 0.4 else [rng.choice(vocabulary)]
        found = license_scan.scan(" ".join(text), auto)
        assert found.words == len(text)
        want = sorted((i, label) for label, p in license_scan.BASE for i in range(len(text)) if text[i : i + len(p.split())] == p.split())
        assert sorted(found.base) == want


def test_matching_statistics_cover_templates():
    auto = license_scan.automaton()
    for label, phrase in license_scan.TEMPLATES:
        words = phrase.split()
        spans = license_scan.scan("some words before " + phrase.upper() + " and after", auto).spans
        assert (3, 3 + len(words), label, 1.0) in spans
        if len(words) > 12:  # one odd word in the middle splits the match; the chain still covers nearly all
            broken = " ".join([*words[: len(words) // 2], "zzz", *words[len(words) // 2 + 1 :]])
            assert max(s[3] for s in license_scan.scan(broken, auto).spans if s[2] == label) >= 0.8


def test_license_scan_rows(docs, no_docs, clashing):
    found = {r["doc_id"]: r for r in license_scan.licenses(clashing).collect() if r["doc_id"] is not None}
    assert (found[10]["n_base"], found[10]["first_word"], found[10]["labels"], found[10]["score"]) == (1, 3, "apache-2", 1.0)
    for d in (5, 6):
        assert tuple(found[d])[1:8] == (0, 0, None, None, "", "", 0.0)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert all(found[r[0]]["n_words"] == len(word.findall((r[1] or "").translate(LOWER))) for r in rows() if r[0] is not None)
    assert license_scan.licenses(docs).count() == len(rows()) and license_scan.licenses(no_docs).count() == 0
