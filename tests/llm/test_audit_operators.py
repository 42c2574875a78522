"""The filter audit, the n-gram join and hard-negative mining against brute force."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit, hard_negatives, ngram_join

WHITE = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- filter audit


def brute_audit(rows, marks):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    good, toxic = ({d for d, q, t in marks if d is not None and (q, t)[k] == 1} for k in range(2))
    seen = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = WHITE.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and doc_id > first[t],
        }
        seen.append((lang or "", {f for f, x in fails.items() if x}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == part]
        worth = Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = set(order[:k])
                now = [s for s in own if f in s[1] and not s[1] & gone]
                worth[f] += len(now)
                out[part, "".join(order), k + 1] = [
                    sum(not s[1] & {*gone, f} for s in own),
                    len(now),
                    sum(f in s[1] for s in own) - len(now),
                    sum(s[1] == {f} for s in own),
                    sum(s[2] for s in now),
                    sum(s[3] for s in now),
                ]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(worth[order[k - 1]])
    return out


def found_audit(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(3)
    rows = [(1, None, None, "a", 0), (2, "", "", "a", 0), (3, " \x0b\x0c ", "en", None, None), (None, "a b", "en", "a", 1), (None, "a b", None, "a", 1), (4, "a b", "en", "a", 1), (4, "a b", "de", "a", 1), (5, "a\x1cb \x85c", "en", "a", 1)]
    for i in range(60):
        n = rng.choice((199, 200, 201, 400))
        words = [f"w{rng.randrange(rng.choice((40, 99, 100, 500)))}" for _ in range(n)]
        if rng.random() < 0.4:
            words = [w.upper() if rng.random() < 0.2 else w for w in words]
        text = " ".join(words) + rng.choice(("", "", " |", " 5% é漢\U0001f600", "\\^-]["))
        rows += [(10 + i, text, rng.choice(("en", "de")), "hot", 1)] * rng.choice((1, 1, 2))
        if rng.random() < 0.3:
            rows.append((200 + i, text, "en", "hot", 1))
    rows.append((999, "long " * 300_000, "de", "a", 1))
    marks = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 80, 2)] + [(10, 1, 1), (10, 0, 0), (None, 1, 1), (77777, 1, 1), (12, None, None)]
    return rows, marks


def test_audit(spark, audited):
    rows, marks = audited
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, marks)
    assert found_audit(filter_audit.audit(docs, labels)) == want
    more = docs.withColumns({c: F.lit("x") for c in ("row", "key", "part", "sides", "fails_A", "first", "n")})
    assert found_audit(filter_audit.audit(more, labels.withColumn("row", F.lit(1)))) == want
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    unmarked = found_audit(filter_audit.audit(docs, labels.limit(0)))
    assert all(unmarked[k][:4] == x[:4] and unmarked[k][4:6] == [0, 0] and unmarked[k][6] == x[6] for k, x in want.items())


# ---- n-gram join


def brute_join(rows, size=4, share=85):
    sets = []
    for _, text, *_ in rows:
        w = WHITE.findall((text or "").translate(LOWER))
        k = min(size, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
            links += sets[i] != sets[j]
            root[find(j)] = find(i)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    return sorted((repr(r[0]), len(sets[i]), repr(least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows)), links


def found_join(df):
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in df.collect())


@pytest.fixture(scope="module")
def near():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    rows, at = [], 1
    for size in (4, 5, 9, 20, 60, 150, 151, 170, 400):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 8):
                copy = base + [word() for _ in range(edits)] if rng.random() < 0.3 else list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = word()
                rows.append((at, " ".join(copy), "en", "a", 0))
                at += 1
    rows += [(500 + i, " ".join(passage + [word() for _ in range(rng.choice((1, 3, 40)))]), "en", "hot", 0) for i in range(40)]
    hot = [word() for _ in range(80)]
    for i in range(60):  # a dense group, some of it linked only through others
        copy = list(hot)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(80)] = word()
        rows.append((700 + i, " ".join(copy), "en", "hot", 0))
    return rows


@pytest.mark.parametrize("cap", [1 << 18, 300])
def test_join(spark, near, monkeypatch, cap):
    monkeypatch.setattr(ngram_join, "CAP", cap)
    want, links = brute_join(near)
    assert links > 150
    assert found_join(ngram_join.groups(spark.createDataFrame(near, DOCS).repartition(5))) == want


@pytest.mark.parametrize("order", [0, 1, 2])
def test_linked_sets_share_every_prefix(near, order):
    sets = [ngram_join.shingles(r[1]) for r in near]
    counters = np.random.default_rng(1).integers(0, 5, ngram_join.COUNTERS).astype(np.uint32)
    tried = 0
    for a, b in itertools.combinations(sets, 2):
        common = len(np.intersect1d(a, b))
        if 100 * common >= ngram_join.SHARE * (len(a) + len(b) - common):
            tried += 1
            assert len(np.intersect1d(ngram_join.prefix(a, order, counters), ngram_join.prefix(b, order, counters)))
            if order == 0:
                small, large = sorted((a, b), key=len)
                assert len(np.intersect1d(ngram_join.prefix(small, 0, counters)[: ngram_join.near_size(len(small))], ngram_join.prefix(large, 0, counters)))
    assert tried > 150


def test_join_odd_rows(spark, docs, no_docs, clashing):
    rows = [tuple(r) for r in docs.collect()]
    odd = [(901, "one two three", "en", "a", 1), (902, "One\x0btwo\x0cTHREE", None, "a", 1), (903, "one two", "en", "a", 1), (904, "ÉCOLE été one two", "en", "a", 1), (905, "école été one two", "en", "a", 1), (906, "w " * 200_000, "en", "a", 1), (907, "w w w w", "en", "a", 1), (None, "one two three", "en", "a", 1)]
    want, _ = brute_join(rows + odd)
    assert found_join(ngram_join.groups(docs.unionByName(docs.sparkSession.createDataFrame(odd, DOCS)))) == want
    want, _ = brute_join(rows)
    assert found_join(ngram_join.groups(clashing.withColumns({c: F.lit(1) for c in ("name", "token", "section", "root", "tile", "id")}))) == want
    assert ngram_join.groups(no_docs).count() == 0
    assert found_join(ngram_join.groups(docs.where("doc_id = 6"))) == [("6", 0, "6")]


# ---- hard negatives


def brute_mine(rows, asks, negatives=10, positives=5):
    usable = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    cells = [[int(np.floor(256 * float(x))) for x in r[2]] for r in usable]
    out = []
    for a, va in zip(usable, cells, strict=True):
        if not asks(a[0]):
            continue
        scored = sorted((max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(va, v, strict=True)))), -r[0], r[1]) for r, v in zip(usable, cells, strict=True) if r[0] != a[0] and len(v) == len(va))[::-1]
        for p, pid, _ in [s for s in scored if s[2] == a[1]][:positives]:
            inside = [s for s in scored if s[2] != a[1] and 30 * p <= 100 * s[0] <= 90 * p][:negatives]
            out += [(a[0], -pid, k + 1, -s[1], p, s[0]) for k, s in enumerate(inside)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>"


def found_mine(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    rows = [(i, rng.choice((0, 0, 0, 1, 2)), [rng.gauss(0.3, 0.4) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, i % 3, [float(rng.randrange(3) - 1) / 256 for _ in range(4)]) for i in range(120)]  # ties and scores of 0
    rows += [(2000 + i, i % 2, []) for i in range(6)]
    rows += [(3000, 1, [1.0, None]), (3100, 1, [float("nan"), 1.0]), (3200, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (3300, 1, None), (3400, 1, [float("inf"), 0.0]), (3500, 1, [2.0, 2.0])]
    rows += [(4000 + i, i % 2, [1e12 * rng.random(), -3e13 * rng.random()]) for i in range(30)]  # beyond exact floats and longs
    rows += rows[100:110] + rows[310:320]  # repeated rows, anchors among them
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_mine(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", max(2, block // 8))
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    want = brute_mine(vectors, lambda i: i % 10 == 0)
    assert len(want) > 500 and any(w[4] == 0 for w in want)
    assert found_mine(hard_negatives.mine(df, F.col("vec_id") % 10 == 0)) == want


def test_mine_odd_tables(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS)
    some = df.where("vec_id < 60").withColumns({c: F.lit("x") for c in ("mark", "tops", "row", "dims", "block", "key", "score", "asks", "lane")})
    assert found_mine(hard_negatives.mine(some, F.col("vec_id") % 10 == 0)) == brute_mine([r for r in vectors if r[0] is not None and r[0] < 60], lambda i: i % 10 == 0)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_windows_take_all_rows():
    """Without the combiner before the shuffle, the iterator alone gives the same."""
    rng = random.Random(9)
    pairs = [(7, 0, rng.randrange(-5, 60), i, rng.random() < 0.2) for i in range(400)] + [(7, 1, rng.randrange(3), i, rng.random() < 0.5) for i in range(90)]
    keys = sorted(hard_negatives.pack(*p) for p in pairs)
    assert [hard_negatives.unpack(k) for k in keys] == sorted(pairs, key=lambda p: (p[0], p[1], -p[2], p[3]))
    want = []
    for mark in (0, 1):
        own = sorted((p for p in pairs if p[1] == mark), key=lambda p: (-p[2], p[3]))
        for pos in [p for p in own if p[4]][:5]:
            inside = [p for p in own if not p[4] and 30 * pos[2] <= 100 * p[2] <= 90 * pos[2]][:10]
            want += [(7, pos[3], k + 1, p[3], pos[2], p[2]) for k, p in enumerate(inside)]
    assert sorted(hard_negatives.windows(keys)) == sorted(want)
