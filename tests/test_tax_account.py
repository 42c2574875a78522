"""Tax-account matching against the plain first-fit loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from ledgerloom.operators import tax_account as T

SCHEMA = "company_id string, fy_start date, date date, amount bigint, id string"
DAY0 = dt.date(2026, 1, 1)


def first_fit(statement, booked, tolerance=3):
    """The list loop: each statement row takes the first free ledger row near enough."""
    free, out = {}, {}
    for r in sorted(booked, key=lambda r: (r[2], r[4])):
        free.setdefault((r[0], r[1], r[3]), []).append(r)
        out["ledger", r[4]] = None
    for r in sorted(statement, key=lambda r: (r[2], r[4])):
        rows = free.get((r[0], r[1], r[3]), [])
        hit = next((b for b in rows if abs((b[2] - r[2]).days) <= tolerance), None)
        out["statement", r[4]] = hit and hit[4]
        if hit:
            rows.remove(hit)
            out["ledger", hit[4]] = r[4]
    return out


def matched(spark, statement, booked, chunk=T.CHUNK):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    return {(r.side, r.id): r.partner for r in T.reconcile(frame(statement), frame(booked), chunk=chunk).collect()}


@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_first_fit(spark, chunk):
    rng = random.Random(chunk)
    make = lambda n, days, name: [(rng.choice("12"), DAY0, DAY0 + dt.timedelta(rng.randrange(days)), rng.choice((100, 100, 200, -300)), f"{name}{i:05d}") for i in range(n)]
    for n, m, days in ((120, 90, 60), (60, 140, 20), (200, 200, 330)):
        statement, booked = make(n, days, "s"), make(m, days, "b")
        assert matched(spark, statement, booked, chunk) == first_fit(statement, booked)


def test_windows_and_years(spark):
    y25, y26 = dt.date(2025, 1, 1), DAY0
    booked = [("1", y25, dt.date(2025, 12, 31), 500, "b1"), ("1", y26, dt.date(2026, 1, 10), 500, "b2"), ("1", y26, dt.date(2026, 1, 14), 500, "b3"), ("1", y26, dt.date(2026, 3, 9), 900, "b4")]
    statement = [("1", y26, dt.date(2026, 1, 1), 500, "s1"), ("1", y26, dt.date(2026, 1, 11), 500, "s2"), ("1", y26, dt.date(2026, 1, 12), 500, "s3"), ("1", y26, dt.date(2026, 3, 5), 900, "s4"), ("1", None, dt.date(2031, 1, 1), 500, "s5")]
    assert matched(spark, statement, booked) == {
        ("statement", "s1"): None, ("statement", "s2"): "b2", ("statement", "s3"): "b3", ("statement", "s4"): None, ("statement", "s5"): None,
        ("ledger", "b1"): None, ("ledger", "b2"): "s2", ("ledger", "b3"): "s3", ("ledger", "b4"): None,
    }
    assert matched(spark, [], booked) == {("ledger", f"b{i}"): None for i in range(1, 5)}
    assert matched(spark, statement, []) == {("statement", f"s{i}"): None for i in range(1, 6)}


def test_one_hot_amount(spark):
    """100,000 rows of one amount: the queue by two pointers over both sides in order."""
    rng = random.Random(2)
    make = lambda n, name: [("1", DAY0, DAY0 + dt.timedelta(min(rng.randrange(360), rng.randrange(360))), 700, f"{name}{i:06d}") for i in range(n)]
    statement, booked = make(52_000, "s"), make(48_000, "b")
    order = sorted(booked, key=lambda r: (r[2], r[4]))
    want, at = {("ledger", r[4]): None for r in booked}, 0
    for r in sorted(statement, key=lambda r: (r[2], r[4])):
        while at < len(order) and (r[2] - order[at][2]).days > 3:
            at += 1
        hit = at < len(order) and (order[at][2] - r[2]).days <= 3
        want["statement", r[4]] = order[at][4] if hit else None
        if hit:
            want["ledger", order[at][4]] = r[4]
            at += 1
    assert sum(v is not None for v in want.values()) > 60_000
    assert matched(spark, statement, booked) == want
