"""Every link between similar texts is a row of its query and a finding of the review chain."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from ledgerloom.operators import cases as C
from ledgerloom.operators import findings as FI
from ledgerloom.operators.controls import base, pattern
from ledgerloom.operators.voucher_facts import voucher_facts
from ledgerloom.plans import control_plans
from tests.test_algorithms import SCHEMA, D, _v

PAIRS = [("A1", "A2"), ("A1", "A3"), ("A1", "A4"), ("A2", "A3"), ("A2", "A4"), ("A3", "A4")]


@pytest.fixture(scope="module")
def book(spark):
    given = [_v(n, D(2026, 1, n), [(6110, 150_000), (1930, -150_000)], f"Faktura från Firma AB nr {100 + n}") for n in (1, 2, 3, 4)]
    return SimpleNamespace(facts=voucher_facts(spark.createDataFrame(given, SCHEMA)).cache(), changed=None)


@pytest.fixture(scope="module")
def found(book):
    return pattern.duplicate_candidate(base.LazyContext(book)).cache()


def test_the_query_lists_every_link(book):
    rows = control_plans.ctl_duplicate_similar(book).collect()
    assert sorted((r.original, r.voucher) for r in rows) == PAIRS
    assert {(r.account, r.amount, r.n_pairs) for r in rows} == {(6110, 150_000, 1)}
    assert {r.days_apart for r in rows if r.original == "A1"} == {1, 2, 3}


def test_every_link_is_a_finding(found):
    rows = found.collect()
    assert sorted(tuple(r.vouchers) for r in rows) == PAIRS and len({r.fingerprint for r in rows}) == 6
    assert {(r.severity, r.variant, r.key) for r in rows} == {("MEDIUM", "similar", "|".join(p)) for p in PAIRS}


def test_precision_counts_every_link(found):
    from pyspark.sql import functions as F

    [rule] = FI.rule_precision(found.withColumn("status", F.lit("NEW"))).collect()
    assert (rule.total, rule.open) == (6, 6)


def test_a_case_has_the_findings_of_every_link(found):
    from pyspark.sql import functions as F

    cases, members = C.build_cases(found.withColumn("status", F.lit("NEW")))
    assert [r.n_findings for r in cases.collect()] == [6] and members.count() == 6


def test_links_that_are_not_measured_are_the_same(spark):
    texts = ["lång text " * 21 + "1", "lång text " * 21 + "2", "faktura nr 11", "faktura nr 12", "12 faktura nr", "avgift mars", "hyra lokal", "hyra lokaler", "avgift maj"]
    given = [_v(n, D(2026, 1, 1 + n % 9), [(6110, 150_000), (1930, -150_000)], t) for n, t in enumerate(texts * 2, 1)]
    facts = voucher_facts(spark.createDataFrame(given, SCHEMA))
    links = [sorted((r.original, r.voucher, r.n_pairs) for r in pattern.similar_links(facts, 100_000, 14, 0.8, measured=m).collect()) for m in (True, False)]
    assert links[0] == links[1] and len(links[0]) == 4
