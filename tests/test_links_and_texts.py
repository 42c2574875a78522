"""In-out links with their members, fingerprints that imports update, and mute rules by text, against plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from ledgerloom.operators import findings as FI
from ledgerloom.operators import versions as V
from ledgerloom.operators.controls import aml
from ledgerloom.operators.voucher_facts import voucher_facts
from tests.test_algorithms import SCHEMA, D, _v


def test_every_in_out_pair_is_in_a_link(spark):
    rng = random.Random(11)
    given = []
    for i in range(90):
        x, day = rng.choice((10_000_000, 10_000_000, 10_400_000, 10_500_000, 10_600_000, 12_000_000)), D(2026, 1, rng.randrange(1, 29))
        given.append(_v(i, day, [(1930, x), (2893, -x)] if i % 2 else [(2393, x), (1930, -x)], series="I" if i % 2 else "O"))
    flows = [(v[2] + v[3], v[4], abs(v[7][0][1]), v[2]) for v in given]
    want = {(a[0], b[0]) for a in flows for b in flows if a[3] == "I" and b[3] == "O" and 0 <= (b[1] - a[1]).days <= 5 and abs(b[2] - a[2]) * 100 <= a[2] * 5}
    facts = voucher_facts(spark.createDataFrame(given, SCHEMA)).cache()
    links = aml.rapid_in_out_links(facts, 10_000_000, 5, 5).cache()
    classes: dict = {}
    for r in aml.rapid_in_out_members(facts, links, 10_000_000).collect():
        classes.setdefault((r.side, r.date, r.amount, r.class_voucher), []).append(r.voucher)
    found = Counter()
    for r in links.collect():
        ins, outs = classes["in", r.in_date, r.in_amount, r.in_voucher], classes["out", r.out_date, r.out_amount, r.out_voucher]
        assert (len(ins), len(outs)) == (r.n_in, r.n_out) and r.in_voucher == min(ins) and r.days == (r.out_date - r.in_date).days
        found.update((a, b) for a in ins for b in outs)
    assert set(found) == want and max(found.values()) == 1 and len(want) > 100


def test_updated_fingerprints_are_those_of_a_rebuild(spark):
    rng = random.Random(3)
    row = lambda i: (str(i % 3), D(2026, 1 + i % 4, 1), hashlib.sha256(str(i).encode()).hexdigest())
    frame = lambda rows: spark.createDataFrame(rows, "company_id string, month date, content_hash string")
    before = [row(i) for i in range(80)] + [row(5)]  # one hash twice
    gone = [r for r in before if rng.random() < 0.3] + [r for r in before if r[0] == "2" and r[1] == D(2026, 3, 1)]
    gone = [r for r in before if r in gone]
    added = [row(i) for i in range(200, 220)]
    after = [r for r in before if r not in gone] + added
    seen = lambda df: sorted((r.company_id, r.month, r.n, r.a, r.b) for r in df.collect())
    rebuilt = seen(V.voucher_parts(frame(after)))
    assert seen(V.updated_parts(V.voucher_parts(frame(before)), frame(added), frame(gone))) == rebuilt
    assert seen(V.updated_parts(V.voucher_parts(frame(before)), frame([]), frame([]))) == seen(V.voucher_parts(frame(before)))
    pairs = spark.createDataFrame([("1", "2026-03", "2026-01", D(2026, 3, 1), D(2026, 3, 31), D(2026, 1, 1), D(2026, 1, 31))], "company_id string, period string, compare string, start date, end date, c_start date, c_end date")
    none = spark.createDataFrame([], "company_id string, fy_start date, kind string, account int, amount bigint")
    prints = lambda rows, told: V.source_fingerprint(pairs, V.voucher_parts(frame(rows)), none, told).first().fingerprint
    assert prints(after, ["a", "b"]) == prints(after[::-1], ["b", "a"])
    assert len({prints(after, ["a"]), prints(after, ["b"]), prints([r for r in after if r[1] != D(2026, 1, 1)], ["a"])}) == 3
    assert prints(after, ["a"]) == prints([r for r in after if r[1] != D(2026, 2, 1)], ["a"])  # a month of neither period


def test_mute_rules_look_at_what_a_finding_says(spark):
    found = spark.createDataFrame(
        [("1", "f1", "UNBALANCED_VOUCHER", "INTERNAL", ["A7"], [6310], 5, ""), ("1", "f2", "UNBALANCED_VOUCHER", "INTERNAL", ["B7"], [1930], 5, ""), ("1", "f3", "AML_LARGE_CASH", "RESTRICTED_AML", ["A7"], [1910], 5, "")],
        "company_id string, fingerprint string, rule_code string, visibility string, vouchers array<string>, accounts array<int>, amount bigint, variant string",
    )

    def muted(rule, text):
        rules = spark.createDataFrame([("s", rule, "r", None, None, None, text, None)], "id string, rule_code string, reason string, expires_at date, company_id string, accounts array<int>, text_contains string, max_amount bigint")
        return sorted(r.fingerprint for r in FI.match_suppressions(found, rules, "2026-01-01").collect())

    assert muted("UNBALANCED_VOUCHER", "BALANSERAR inte") == ["f1", "f2"]
    assert muted("UNBALANCED_VOUCHER", "inte b7") == ["f2"] and muted("UNBALANCED_VOUCHER", "6310") == ["f1"]
    assert muted("UNBALANCED_VOUCHER", "kontant") == [] and muted("AML_LARGE_CASH", "kontant") == []
