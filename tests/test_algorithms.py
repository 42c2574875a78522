"""Pair, component, chain and streaming algorithms against brute force on small fixtures."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cases as C
from ledgerloom.operators import ledger as L
from ledgerloom.operators import spend as E
from ledgerloom.operators.controls import base, integrity, pattern
from ledgerloom.operators.voucher_facts import voucher_facts
from ledgerloom.streaming.landing import stream

ROWS = "array<struct<account:int,amount:bigint,text:string,status:string>>"
SCHEMA = f"company_id string, fy_start date, series string, number string, voucher_date date, reg_date date, text string, rows {ROWS}"
D = dt.date


def _v(number, day, rows, text="Faktura", series="A", company="1"):
    body = [(a, x, None, "normal") for a, x in rows]
    return (company, D(day.year, 1, 1), series, str(number), day, day, text, body)


def test_voucher_facts_patterns(spark):
    given = [
        _v(1, D(2026, 1, 5), [(2611, 100), (2650, -100)]),
        _v(2, D(2026, 1, 5), [(7210, 100), (2710, -30), (1930, -70)]),
        _v(3, D(2026, 1, 5), [(1930, 500), (1510, -500)]),
        _v(4, D(2026, 1, 5), [(5010, 100), (2641, 25), (2440, -125)]),
        _v(5, D(2026, 1, 5), [(6570, 10), (1930, -10)]),
        _v(6, D(2026, 1, 5), [(6310, 100), (6310, 50), (2440, -150)]),
    ]
    got = {r.number: r for r in voucher_facts(spark.createDataFrame(given, SCHEMA)).collect()}
    assert got["1"].tags == ["vat_settlement"] and got["1"].routine
    assert got["2"].tags == ["payroll"] and not got["4"].routine
    assert got["3"].tags == ["customer_payment"]
    assert got["4"].tags == ["supplier_invoice"] and (got["4"].input_vat, got["4"].cost_base) == (25, 100)
    assert got["5"].tags == ["bank_fee"]
    assert got["6"].exempt_only and (got["6"].debit_account, got["6"].credit_account) == (6310, 2440)
    assert got["6"].debit_total == 150 and got["6"].accounts == [2440, 6310]


def _duplicate_fixture():
    rnd = random.Random(7)
    texts = ["hyra januari", "hyra januari 2", "hyra februari", "kontorsmaterial", "kontorsmateriel ab", "hyra januari"]
    return [
        _v(i, D(2026, 1, 1) + dt.timedelta(rnd.randrange(40)), [(6110, 150_000), (1930, -150_000)], rnd.choice(texts))
        for i in range(100, 160)
    ]


def test_duplicates_against_brute_force(spark):
    given = _duplicate_fixture()
    facts = voucher_facts(spark.createDataFrame(given, SCHEMA)).cache()
    items = sorted((v[4], v[2] + v[3], v[6]) for v in given)
    exact = 0
    for (d1, k1, t1), (d2, k2, t2) in itertools.combinations(items, 2):
        if (d2 - d1).days > 14:
            continue
        if t1 == t2:
            exact += 1
    found = pattern.exact_duplicates(facts, 100_000, 14)
    days = found.select("account", "amount", "norm", "voucher_date", "n_pairs").distinct()
    assert days.agg(F.sum("n_pairs")).first()[0] == exact


def test_number_gaps_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(integrity, "CHUNK", 10)
    numbers = [1, 2, 3, 7, 8, 25, 26, 26, 9000]
    facts = voucher_facts(spark.createDataFrame([_v(n, D(2026, 1, 5), [(1930, 1), (1510, -1)]) for n in numbers], SCHEMA))
    ctx = base.Context(*([facts] + [None] * 9))
    got = sorted((r.variant, r.vouchers) for r in integrity.number_gap(ctx).collect())
    assert got == [
        ("duplicate", ["A26"]),
        ("gap", ["A27", "A8999"]),
        ("gap", ["A4", "A6"]),
        ("gap", ["A9", "A24"]),
    ]


def _related(a, b):
    aml = lambda x: x["visibility"] == "RESTRICTED_AML"
    if aml(a) != aml(b):
        return False
    if set(a["vouchers"]) & set(b["vouchers"]):
        return True
    if aml(a):
        return False
    same = [f for f, rules in C.FAMILIES.items() if a["rule_code"] in rules and b["rule_code"] in rules]
    if not same or a["period"] != b["period"]:
        return False
    if a["rule_code"] == b["rule_code"]:
        return a["rule_code"] in C.SAME_RULE
    return bool(set(a["accounts"]) & set(b["accounts"])) or any(f in C.PERIOD_FAMILIES for f in same)


def test_cases_against_brute_force(spark):
    rnd = random.Random(3)
    rules = sorted({r for rs in C.FAMILIES.values() for r in rs}) + ["AML_LARGE_CASH"]
    found = []
    for i in range(120):
        rule = rnd.choice(rules)
        found.append(
            {
                "company_id": "1",
                "fingerprint": f"f{i:03d}",
                "rule_code": rule,
                "severity": rnd.choice(["HIGH", "MEDIUM", "LOW"]),
                "visibility": "RESTRICTED_AML" if rule.startswith("AML") else "INTERNAL",
                "period": rnd.choice(["2026-01", "2026-02", "2026-03"]),
                "vouchers": [f"A{rnd.randrange(150)}"] if rnd.random() < 0.6 else [],
                "accounts": [rnd.choice([1930, 2641, 6110, 2440])] if rnd.random() < 0.5 else [],
                "status": "NEW",
            }
        )
    parent = list(range(len(found)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(found)), 2):
        if _related(found[i], found[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {}
    for i, f in enumerate(found):
        want.setdefault(root(i), set()).add(f["fingerprint"])
    schema = "company_id string, fingerprint string, rule_code string, severity string, visibility string, period string, vouchers array<string>, accounts array<int>, status string"
    _, members = C.build_cases(spark.createDataFrame([tuple(f.values()) for f in found], schema))
    got = {}
    for r in members.collect():
        got.setdefault(r.component, set()).add(r.fingerprint)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_opening_chain(spark):
    years = [("1", D(y, 1, 1), D(y, 12, 31), True, "missing", None) for y in (2024, 2025, 2026)]
    fy = spark.createDataFrame(years, "company_id string, fy_start date, fy_end date, has_vouchers boolean, opening_status string, covered_months array<date>")
    yb = spark.createDataFrame([("1", D(2024, 1, 1), "IB", 1930, 1000), ("1", D(2024, 1, 1), "IB", 2081, -1000)], "company_id string, fy_start date, kind string, account int, amount bigint")
    mv = spark.createDataFrame(
        [("1", D(2024, 5, 1), 1930, 300), ("1", D(2024, 5, 1), 3001, -300), ("1", D(2025, 2, 1), 1930, -50), ("1", D(2025, 2, 1), 5010, 50)],
        "company_id string, month date, account int, amount bigint",
    )
    basis = L.opening_basis(fy, yb)
    got = {(r.fy_start.year, r.account): r.amount for r in L.opening_balances(mv, basis, yb).collect()}
    assert got == {
        (2024, 1930): 1000, (2024, 2081): -1000, (2025, 1930): 1300, (2025, 2081): -1000, (2025, 2099): -300,
        (2026, 1930): 1250, (2026, 2081): -1000, (2026, 2099): -250,
    }
    assert all(r.opening_known for r in basis.collect())


def test_opening_from_closing_balances_imbalance(spark):
    fy = spark.createDataFrame(
        [("1", D(2024, 1, 1), D(2024, 12, 31), False, "missing", None), ("1", D(2025, 1, 1), D(2025, 12, 31), True, "missing", None)],
        "company_id string, fy_start date, fy_end date, has_vouchers boolean, opening_status string, covered_months array<date>",
    )
    yb = spark.createDataFrame([("1", D(2024, 1, 1), "UB", 1930, 700), ("1", D(2024, 1, 1), "UB", 2081, -500)], "company_id string, fy_start date, kind string, account int, amount bigint")
    mv = spark.createDataFrame([], "company_id string, month date, account int, amount bigint")
    got = {r.account: r.amount for r in L.opening_balances(mv, L.opening_basis(fy, yb), yb).where("fy_start = DATE'2025-01-01'").collect()}
    assert got == {1930: 700, 2081: -500, 2099: -200}


def test_period_balances_and_annual_years(spark):
    yb = spark.createDataFrame(
        [("1", D(2025, 1, 1), "IB", 1930, 100), ("1", D(2025, 1, 1), "UB", 1930, 250), ("1", D(2025, 1, 1), "RES", 3001, -150)],
        "company_id string, fy_start date, kind string, account int, amount bigint",
    )
    pa = spark.createDataFrame(
        [("1", D(2025, 1, 1), "PSALDO", D(2025, 1, 1), 1930, 130), ("1", D(2025, 1, 1), "PSALDO", D(2025, 2, 1), 1930, 170), ("1", D(2025, 1, 1), "PSALDO", D(2025, 1, 1), 3001, -30)],
        "company_id string, fy_start date, kind string, month date, account int, amount bigint",
    )
    got = sorted((r.month.month, r.account, r.amount) for r in L.psaldo_movements(pa, yb).collect())
    assert got == [(1, 1930, 30), (1, 3001, -30), (2, 1930, 40)]
    fy = spark.createDataFrame([("1", D(2025, 1, 1), D(2025, 12, 31), False, "missing", None)], "company_id string, fy_start date, fy_end date, has_vouchers boolean, opening_status string, covered_months array<date>")
    annual = {r.account: r.amount for r in L.annual_movements(yb, fy).collect()}
    assert annual == {1930: 150, 3001: -150}
    sources = {r.source for r in L.month_coverage(fy, None, yb).collect()}
    assert sources == {"annual"}


def test_recurrence_classes(spark):
    rows = [(list(range(1, 13)), 12), ([3, 6, 9, 12], 12), ([12], 12), ([12], 3), ([], 12), ([1, 2, 9], 12), ([1, 13], 13)]
    df = spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(rows)], "i int, a array<int>, n int").coalesce(1).orderBy("i")
    got = [r[0] for r in df.select(E.recurrence(F.col("a"), F.col("n"))).collect()]
    assert got == ["monthly", "quarterly", "one_off", "unknown", "unknown", "irregular", "annual"]


def _shift(spark, values):
    months = [D(2025 + (i // 12), i % 12 + 1, 1) for i in range(len(values))]
    end = months[-1]
    spend = spark.createDataFrame(
        [("1", "x", m, v * 100, [5010], (D(2025, 1, 1), "x", 98, "alias")) for m, v in zip(months, values, strict=True) if v],
        "company_id string, cp_key string, month date, amount bigint, accounts array<int>, seen struct<first:date,cp_name:string,cp_confidence:int,cp_source:string>",
    )
    cov = spark.createDataFrame([("1", m) for m in months], "company_id string, month date")
    pairs = spark.createDataFrame([("1", "p", "c", end, end + dt.timedelta(27), end, end)], "company_id string, period string, compare string, start date, end date, c_start date, c_end date")
    return E.level_shifts(pairs, spend, cov).collect()


def test_level_shift_and_seasonality(spark):
    rows = _shift(spark, [72, 69, 73, 113, 115, 111, 112, 114, 110])
    assert [(r.shift_month, r.before) for r in rows] == [(D(2025, 4, 1), 7133)]
    assert _shift(spark, [300, 0, 0] * 8) == []


def test_landing_is_incremental_and_idempotent(spark, tmp_path):
    src, root, cp = (str(tmp_path / n) for n in ("src", "root", "cp"))
    one = [_v(1, D(2026, 1, 5), [(1930, 100), (3001, -100)]), _v(2, D(2026, 2, 5), [(1930, 40), (3001, -40)])]
    two = [_v(2, D(2026, 2, 5), [(1930, 60), (3001, -60)]), _v(3, D(2025, 2, 5), [(1930, 7), (3001, -7)])]
    from ledgerloom.streaming.landing import Landing

    for part in (one, two, two):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        query = stream(spark, src, root, cp)
        query.awaitTermination()
    land = Landing(spark, root)
    got = {(r.month.year, r.month.month, r.account): r.amount for r in land.movements().collect()}
    assert got == {(2026, 1, 1930): 100, (2026, 1, 3001): -100, (2026, 2, 1930): 60, (2026, 2, 3001): -60, (2025, 2, 1930): 7, (2025, 2, 3001): -7}
    versions = sorted((r.number, r.valid_from, r.valid_to) for r in land.versions().collect())
    assert versions == [("1", 1, None), ("2", 1, 2), ("2", 2, None), ("3", 2, None)]
    batch = spark.createDataFrame(two, SCHEMA)
    land.merge(batch, 1, query.id)  # a batch repeated after a failure
    assert sorted((r.number, r.valid_from, r.valid_to) for r in land.versions().collect()) == versions


def test_landing_loses_and_doubles_nothing(spark, tmp_path):
    from ledgerloom.streaming.landing import Landing

    src, root = (str(tmp_path / n) for n in ("src", "root"))
    first = [_v("", D(2026, 1, 5), [(1930, 100), (3001, -100)]), _v(2, D(2026, 1, 6), [(1930, 40), (3001, -40)], company="2")]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(src)
    stream(spark, src, root, str(tmp_path / "cp1")).awaitTermination()
    land = Landing(spark, root)
    bodies = land.vouchers().collect()
    assert len(bodies) == 2 and any(r.number.startswith("h:") for r in bodies)  # a voucher without a number has a body
    moved = [_v(2, D(2026, 2, 6), [(1930, 40), (3001, -40)], company="2")]
    src2 = str(tmp_path / "src2")
    spark.createDataFrame(moved, SCHEMA).coalesce(1).write.parquet(src2)
    stream(spark, src2, root, str(tmp_path / "cp2")).awaitTermination()  # another stream's first batch
    got = {(r.company_id, r.month.month, r.account): r.amount for r in land.movements().collect()}
    assert got == {("1", 1, 1930): 100, ("1", 1, 3001): -100, ("2", 2, 1930): 40, ("2", 2, 3001): -40}
    versions = {(r.company_id, r.valid_from, r.valid_to) for r in land.versions().collect()}
    assert versions == {("1", 1, None), ("2", 1, 2), ("2", 2, None)}


def test_landing_sees_a_changed_cost_centre(spark, tmp_path):
    from ledgerloom.schema import VOUCHERS
    from ledgerloom.streaming.landing import Landing

    land = Landing(spark, str(tmp_path / "root"))

    def deliver(batch_id, unit):
        row = (5010, 100, None, None, None, [("1", unit)], "normal", 1)
        land.merge(spark.createDataFrame([("1", D(2026, 1, 1), "A", "1", D(2026, 1, 5), None, "Hyra", [row])], VOUCHERS), batch_id, "s")

    deliver(0, "10")
    deliver(1, "10")
    deliver(2, "20")
    assert [r.rows[0].objects[0].obj for r in land.vouchers().collect()] == ["20"]
    assert sorted((r.valid_from, r.valid_to) for r in land.versions().collect()) == [(1, 3), (3, None)]


def _files(root):
    return {str(f): f.stat().st_size for f in root.rglob("*.parquet")}


def test_a_small_batch_writes_little_whatever_the_table_holds(spark, tmp_path):
    from ledgerloom.streaming.landing import Landing

    wrote = []
    for count in (20, 4000):
        root = tmp_path / f"root{count}"
        land = Landing(spark, str(root))
        many = [_v(i, D(2026, 1 + i % 12, 5), [(1930 + i % 9, 100 + i), (3001, -100 - i)]) for i in range(count)]
        land.merge(spark.createDataFrame(many, SCHEMA), 0, "s")
        land.compact()
        before = _files(root)
        land.merge(spark.createDataFrame([_v(7, D(2026, 8, 5), [(1930, 5), (3001, -5)])], SCHEMA), 1, "s")
        after = _files(root)
        assert all(after[f] == size for f, size in before.items())  # nothing is written again
        wrote.append(sum(size for f, size in after.items() if f not in before))
        assert {(r.account, r.amount) for r in land.vouchers().where("number = '7'").select(F.explode("rows").alias("r")).select("r.account", "r.amount").collect()} == {(1930, 5), (3001, -5)}
    assert wrote[1] <= wrote[0] * 1.2


def test_compaction_changes_no_reader_and_survives_repeats(spark, tmp_path):
    from ledgerloom.operators import ledger as L
    from ledgerloom.streaming.landing import Landing

    land = Landing(spark, str(tmp_path / "root"))
    seen = lambda: tuple(sorted(map(str, df.collect())) for df in (land.versions(), land.vouchers(), land.movements()))
    assert land.compact() == [] and seen() == ([], [], [])
    batches = [
        [_v(i, D(2025 + i % 2, 3, 5), [(1930, 100 + i), (3001, -100 - i)]) for i in range(12)],
        [_v(3, D(2026, 4, 5), [(1930, 1), (3001, -1)]), _v(50, D(2026, 4, 5), [(1930, 9), (3001, -9)])],
        [_v(3, D(2026, 4, 5), [(1930, 2), (2440, -2)]), _v(4, D(2025, 3, 5), [(1930, 104), (3001, -104)])],
    ]
    for n, rows in enumerate(batches):
        land.merge(spark.createDataFrame(rows, SCHEMA), n, "s")
        state = seen()
        years = land.compact()
        assert seen() == state and years == ([D(2025, 1, 1), D(2026, 1, 1)] if n == 0 else [D(2026, 1, 1)])
        land.merge(spark.createDataFrame(rows, SCHEMA), n, "s")  # repeated after it was folded
        assert seen() == state and land.compact() == []
    want = {(str(r.month), r.account, r.amount) for r in L.monthly_movements(land.vouchers()).collect()}
    assert {(str(r.month), r.account, r.amount) for r in land.movements().collect()} == want
    assert [(r.valid_from, r.valid_to) for r in land.versions().where("number = '3'").orderBy("valid_from").collect()] == [(1, 2), (2, 3), (3, None)]


def test_a_batch_that_broke_off_is_not_folded(spark, tmp_path, monkeypatch):
    from ledgerloom.streaming import landing as module
    from ledgerloom.streaming.landing import Landing

    land = Landing(spark, str(tmp_path / "root"))
    land.merge(spark.createDataFrame([_v(1, D(2026, 1, 5), [(1930, 5), (3001, -5)])], SCHEMA), 0, "s")
    second = spark.createDataFrame([_v(1, D(2026, 1, 5), [(1930, 8), (3001, -8)])], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(module, "_summed", lambda df: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            land.merge(second, 1, "s")
    assert land._complete() == 1
    land.compact()
    land.merge(second, 1, "s")
    assert {(r.account, r.amount) for r in land.movements().collect()} == {(1930, 8), (3001, -8)}
    assert sorted((r.valid_from, r.valid_to) for r in land.versions().collect()) == [(1, 2), (2, None)]
