"""Small table operators: exports, merging of files and coverage, period texts, dated rates, visibility."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import rates
from ledgerloom.operators import cases as C
from ledgerloom.operators import periods as P
from ledgerloom.operators import versions as V
from ledgerloom.operators.visibility import mask_rows
from ledgerloom.sources import exports, sie, standard

D = dt.date
COVERAGE = "company_id string, month date, fy_start date, fy_end date, covered boolean"


@pytest.fixture(scope="module")
def coverage(spark):
    rows = [("1", D(2026, m, 1), D(2026, 1, 1), D(2026, 12, 31), m < 10) for m in range(1, 13)]
    rows += [("2", D(2025 + (m + 6) // 12, (m + 6) % 12 + 1, 1), D(2025, 7, 1), D(2026, 6, 30), True) for m in range(12)]
    return spark.createDataFrame(rows, COVERAGE)


def test_exports_flatten_and_keep_everything(spark, tmp_path):
    df = spark.createDataFrame([("1", 12345, ["A1", "A2"], "RESTRICTED_AML"), ("2", -5, [], "INTERNAL"), ("3", None, None, None)], "company_id string, amount bigint, vouchers array<string>, visibility string")
    for fmt in exports.FORMATS:
        exports.export(df, str(tmp_path / fmt), fmt)
    back = spark.read.option("header", "true").option("sep", ";").csv(str(tmp_path / "csv"))
    assert {(r.company_id, r.amount, r.vouchers) for r in back.collect()} == {("1", "123.45", "A1,A2"), ("2", "-0.05", None), ("3", None, None)}
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == spark.read.json(str(tmp_path / "json")).count() == 3
    exports.export_aml(df, str(tmp_path / "aml"))
    assert [r.company_id for r in spark.read.option("header", "true").option("sep", ";").csv(str(tmp_path / "aml")).collect()] == ["1"]
    with pytest.raises(ValueError):
        exports.export(df, str(tmp_path / "x"), "xml")


def test_files_of_a_company_are_merged(spark):
    years = spark.createDataFrame(
        [("1", D(2026, 1, 1), True, 1, "a"), ("1", D(2026, 1, 1), False, 2, "b"), ("1", D(2025, 1, 1), False, 1, "a"), ("1", D(2025, 1, 1), False, 2, "b")],
        "company_id string, fy_start date, has_vouchers boolean, file_order int, file string",
    )
    assert {(r.fy_start, r.file) for r in sie.merge_years(years).collect()} == {(D(2026, 1, 1), "a"), (D(2025, 1, 1), "b")}


def test_coverage_of_partial_imports_adds_up(spark):
    schema = "company_id string, fy_start date, covered_months array<date>"
    jan, feb = D(2026, 1, 1), D(2026, 2, 1)
    old = spark.createDataFrame([("1", jan, [jan]), ("2", jan, None)], schema)
    new = spark.createDataFrame([("1", jan, [feb]), ("2", jan, [feb]), ("3", jan, [feb])], schema)
    assert {r.company_id: r.covered_months for r in V.merge_coverage(old, new).collect()} == {"1": [jan, feb], "2": None, "3": [feb]}


def test_import_history_keeps_runs_without_file(spark):
    runs = spark.createDataFrame([("1", "f1", 1), ("1", "f2", 2)], "company_id string, source_file_id string, seq int")
    files = spark.createDataFrame([("1", "f1", "a.se")], "company_id string, source_file_id string, name string")
    assert [(r.seq, r.name) for r in V.import_history(runs, files).collect()] == [(2, None), (1, "a.se")]


def test_accounts_outside_the_chart(spark):
    v = spark.createDataFrame([("1", [(1930,), (6993,)]), ("1", [(6993,)]), ("2", [(1930,)])], "company_id string, rows array<struct<account:int>>")
    chart = spark.createDataFrame([("1", 1930)], "company_id string, account int")
    assert {(r.company_id, r.account) for r in standard.check_accounts(v, chart).collect()} == {("1", 6993), ("2", 1930)}


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ("2026-03", {"1": (D(2026, 3, 1), D(2026, 3, 31)), "2": (D(2026, 3, 1), D(2026, 3, 31))}),
        ("2026-Q2", {"1": (D(2026, 4, 1), D(2026, 6, 30)), "2": (D(2026, 4, 1), D(2026, 6, 30))}),
        ("YTD:2026-03", {"1": (D(2026, 1, 1), D(2026, 3, 31)), "2": (D(2025, 7, 1), D(2026, 3, 31))}),
        ("FY:2026-01", {"1": (D(2026, 1, 1), D(2026, 12, 31))}),
        ("R12:2026-03", {"1": (D(2025, 4, 1), D(2026, 3, 31)), "2": (D(2025, 4, 1), D(2026, 3, 31))}),
        ("2026-02-10..2026-04-05", {"1": (D(2026, 2, 10), D(2026, 4, 5)), "2": (D(2026, 2, 10), D(2026, 4, 5))}),
    ],
)
def test_period_texts(coverage, spec, want):
    assert {r.company_id: (r.start, r.end) for r in P.periods_for(spec, coverage).collect()} == want


def test_unknown_period_text(coverage):
    with pytest.raises(ValueError):
        P.periods_for("2026-Q5", coverage)


def test_dated_rates_agree_with_their_table(spark):
    days = spark.createDataFrame([(D(y, m, 1),) for y in range(2015, 2029) for m in (1, 4, 10)], "day date")
    for code in {r[0] for r in rates.RATES}:
        single = [r for r in rates.RATES if r[0] == code]
        if any(a is not b and a[2] <= (b[3] or "9999") and b[2] <= (a[3] or "9999") for a in single for b in single):
            continue  # several values at a time
        joined = rates.as_of(days, rates.rates_table(spark), code, "day").select("day", "value")
        cased = days.select("day", rates.rate_on(code, F.col("day")).alias("value"))
        assert sorted(map(str, joined.collect())) == sorted(map(str, cased.collect()))


def test_payroll_rows_are_hidden(spark):
    rows = spark.createDataFrame([(7210,), (1930,), (2710,)], "account int")
    assert 7210 not in {r.account for r in mask_rows(rows).collect()} and mask_rows(rows).where("account = 1930").count() == 1


def test_cases_are_ranked_within_companies(spark):
    cases = spark.createDataFrame([("1", "LOW", "2026-01", "a"), ("1", "HIGH", "2026-02", "b"), ("2", "MEDIUM", "2026-01", "c")], "company_id string, severity string, period string, case_key string")
    assert {(r.case_key, r.position) for r in C.within_company(cases).collect()} == {("b", 1), ("a", 2), ("c", 1)}
