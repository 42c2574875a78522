"""Reversals: only signatures booked in both directions are carried on, and these are found."""

from __future__ import annotations

from ledgerloom.operators.controls import base, pattern
from ledgerloom.operators.voucher_facts import voucher_facts
from tests.test_algorithms import SCHEMA, D, _v


def test_one_sided_signatures_are_dropped_before_rows_are_carried(spark, monkeypatch):
    given = [_v(n, D(2026, 1, n), [(6110, 600_000 + n), (1930, -600_000 - n)], "en väg") for n in range(1, 21)]
    given += [_v(31, D(2026, 2, 2), [(5010, 700_000), (1930, -700_000)], "bokad"), _v(32, D(2026, 2, 5), [(5010, -700_000), (1930, 700_000)], "vänd")]
    carried, stage = {}, pattern.stage
    monkeypatch.setattr(pattern, "stage", lambda df, name, **kw: carried.setdefault(name, stage(df, name, **kw)))
    facts = voucher_facts(spark.createDataFrame(given, SCHEMA))
    found = pattern.rapid_reversal(base.Context(*([facts] + [None] * 9))).collect()
    assert [(r.vouchers, r.variant, r.amount) for r in found] == [(["A31", "A32"], "3d/1", 700_000)]
    assert sorted(r.voucher for r in carried["reversal_rows"].collect()) == ["A31", "A32"]
