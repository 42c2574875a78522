"""All links between similar texts, against brute force."""

from __future__ import annotations

import itertools
from difflib import SequenceMatcher

from ledgerloom.operators.controls import pattern
from ledgerloom.operators.voucher_facts import voucher_facts
from tests.test_algorithms import SCHEMA, D, _duplicate_fixture, _v


def test_a_partner_that_is_not_the_nearest_keeps_its_link(spark):
    texts = ["aabcdefghi", "abcdefghij", "bcdefghijj"]  # the one in the middle is booked last
    days = [(1, 0), (2, 2), (3, 1)]
    given = [_v(n, D(2026, 1, n), [(6110, 150_000), (1930, -150_000)], texts[t]) for n, t in days]
    alike = lambda a, b: SequenceMatcher(None, texts[a], texts[b]).ratio() >= 0.85
    assert alike(0, 1) and alike(2, 1) and not alike(0, 2)
    found = pattern.similar_links(voucher_facts(spark.createDataFrame(given, SCHEMA)), 100_000, 14, 0.85).where("account = 6110")
    assert sorted((r.original, r.voucher, r.days_apart) for r in found.collect()) == [("A1", "A3", 2), ("A2", "A3", 1)]


def test_links_against_brute_force(spark):
    given = _duplicate_fixture()
    groups: dict = {}
    for v in given:
        groups.setdefault((v[4], v[6]), []).append(v[2] + v[3])
    want = set()
    for ((d1, t1), a), ((d2, t2), b) in itertools.permutations(groups.items(), 2):
        if (d1, min(a)) < (d2, min(b)) and (d2 - d1).days <= 14 and t1 != t2 and SequenceMatcher(None, t1, t2).ratio() >= 0.8:
            want.add((min(a), min(b), (d2 - d1).days, len(a) * len(b)))
    found = pattern.similar_links(voucher_facts(spark.createDataFrame(given, SCHEMA)), 100_000, 14, 0.8).collect()
    assert {(r.original, r.voucher, r.days_apart, r.n_pairs) for r in found} == want and len(found) == len(want)
