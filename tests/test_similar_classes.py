"""Similar texts counted by day and text, against brute force, and without listing the links."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from ledgerloom.operators.controls import pattern
from ledgerloom.operators.voucher_facts import voucher_facts
from tests.test_algorithms import SCHEMA, D, _v


def _brute(given, min_ratio):
    groups: dict = {}
    for v in given:
        groups.setdefault((v[4], pattern_norm(v[6])), []).append(v[2] + v[3])
    want = {}
    for (d2, t2), b in groups.items():
        links = [
            (d1, min(a), len(set(a)), SequenceMatcher(None, t1, t2).ratio())
            for (d1, t1), a in groups.items()
            if (d1, min(a)) < (d2, min(b)) and not (d1 == d2 and min(a) == min(b)) and (d2 - d1).days <= 14 and t1 != t2 and SequenceMatcher(None, t1, t2).ratio() >= min_ratio
        ]
        if links:
            d1, first = max(x[:2] for x in links)
            want[min(b), d2] = (first, (d2 - d1).days, len(links), sum(x[2] for x in links) * len(set(b)))
    return want


def pattern_norm(text):
    return " ".join(text.lower().split())


def _texts(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return f"Leverantörsfaktura Brand#{rng.randrange(1, 12)} AB nr {rng.randrange(1, 3000)}"
    if kind == 1:
        return f"{rng.randrange(1, 400)} hyra lokal Storgatan"
    if kind == 2:
        return "".join(rng.choice("ab ") for _ in range(rng.randrange(3, 9))).strip() or "a"
    if kind == 3:
        return "lång text " * 21 + str(rng.randrange(100, 130))
    return rng.choice(["Autogiro large ring", "Autogiro  LARGE ring", "Autogiro large rings"])


def test_counted_links_against_brute_force(spark):
    rng = random.Random(5)
    for min_ratio in (0.8, 0.5):
        given = [_v(n, D(2026, 1 + n % 2, rng.randrange(1, 29)), [(6110, 150_000), (1930, -150_000)], _texts(rng)) for n in range(1, 260)]
        found = pattern.similar_classes(voucher_facts(spark.createDataFrame(given, SCHEMA)), 100_000, 14, min_ratio).where("account = 6110").collect()
        got = {(r.voucher, r.voucher_date): (r.original, r.days_apart, r.n_links, r.n_pairs) for r in found}
        assert len(got) == len(found) > 100 and got == _brute(given, min_ratio)


def test_shared_numbers_are_compared_pair_by_pair(spark):
    """Vouchers of one day and number have no order among themselves."""
    given = [_v(n, D(2026, 1, d), [(6110, 150_000), (1930, -150_000)], f"Faktura från Firma AB nr {t}") for n, d, t in ((1, 3, 100), (1, 3, 200), (2, 3, 300), (3, 5, 100))]
    facts = voucher_facts(spark.createDataFrame(given, SCHEMA))
    found = pattern.similar_classes(facts, 100_000, 14, 0.8).where("account = 6110").collect()
    listed = pattern.similar_links(facts, 100_000, 14, 0.8).where("account = 6110").groupBy("voucher").count().collect()
    assert {r.voucher: r.n_links for r in found} == {r.voucher: r["count"] for r in listed} == {"A2": 2, "A3": 2}


def test_a_crowd_is_one_row_per_text(spark):
    """The links of 1500 alike texts of one day number 1.1 million; they are counted."""
    given = [_v(n, D(2026, 1, 3), [(6110, 150_000), (1930, -150_000)], f"Faktura från Firma AB nr {n}") for n in range(10_000, 11_500)]
    found = pattern.similar_classes(voucher_facts(spark.createDataFrame(given, SCHEMA)), 100_000, 14, 0.8).where("account = 6110").cache()
    assert found.count() == 1499 and found.agg({"n_links": "sum"}).first()[0] == 1500 * 1499 // 2
