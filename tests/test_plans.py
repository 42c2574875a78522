"""Registered queries against SQL on the smallest tables, and smaller table operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.operators import ledger as L
from ledgerloom.operators import statements as S
from ledgerloom.operators import versions as V
from ledgerloom.operators.visibility import client_safe, visible_findings
from ledgerloom.sources import sie
from tests.conftest import DATA
from tools.check import compare, duck

D = dt.date


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize(
    "name",
    ["monthly_movements", "income_statement", "balance_sheet", "balance_identity", "key_figures", "ctl_number_gap", "ctl_input_vat", "spend_report", "voucher_versions"],
)
def test_query_equals_sql(spark, con, name):
    ok, info = compare(spark, con, name, DATA, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, info


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_statement_rows_stay_on_the_jvm_and_prune(spark):
    from ledgerloom.sources import demo

    plan = L.monthly_movements(demo.vouchers(spark, DATA, text=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "l_discount" not in plan and "c_name" not in plan


def test_date_filters_skip_fiscal_years(spark, book):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (L.transactions(book.vouchers, start="2024-01-01", end="2025-06-30"), L.registered_late(book.vouchers, "2025-03-01")):
        filters = [line for line in plan(df).splitlines() if "PartitionFilters" in line]
        assert filters and all("fy_start" in line.split("PartitionFilters")[1].split("]")[0] for line in filters)


def test_overrides_company_before_firm(spark):
    o = spark.createDataFrame([(None, "statement", 5010, "materials"), ("2", "statement", 5010, "personnel")], "company_id string, kind string, account int, target string")
    m = spark.createDataFrame([(c, D(2026, 1, 1), 5010, 100) for c in ("1", "2")], "company_id string, month date, account int, amount bigint")
    got = {r.company_id: (r.materials, r.personnel, r.other_external) for r in S.monthly_lines(m, o).collect()}
    assert got == {"1": (-100, 0, 0), "2": (0, -100, 0)}


def test_voucher_lookup_prefers_anchor_year(spark):
    rows = [("1", D(y, 1, 1), "A", "7", D(y, 2, 1)) for y in (2024, 2025, 2026)]
    v = spark.createDataFrame(rows, "company_id string, fy_start date, series string, number string, voucher_date date")
    assert L.find_voucher(v, "A", "7").first().fy_start == D(2026, 1, 1)
    assert L.find_voucher(v, "A", "7", "2025-06-01").first().fy_start == D(2025, 1, 1)


def test_imports_carry_forward_and_sequences(spark):
    schema = "company_id string, fy_start date, kind string, month date, account int, amount bigint"
    old = spark.createDataFrame([("1", D(2026, 1, 1), "IB", None, 1930, 5), ("1", D(2026, 1, 1), "UB", None, 1930, 9)], schema)
    new = spark.createDataFrame([("1", D(2026, 1, 1), "RES", None, 3001, 7)], schema)
    scope = spark.createDataFrame([("1", D(2026, 1, 1))], "company_id string, fy_start date")
    assert [(r.kind, r.amount) for r in V.carry_forward(new, old, scope).collect()] == [("IB", 5)]
    runs = spark.createDataFrame(
        [("1", D(2026, 1, 1), True, 3, "COMPLETE"), ("1", D(2026, 1, 1), False, 4, "COMPLETE"), ("1", D(2026, 1, 1), True, 2, "COMPLETE")],
        "company_id string, fy_start date, has_vouchers boolean, seq int, status string",
    )
    assert V.latest_imports(runs).first().seq == 3
    files = spark.createDataFrame([("1", "a", D(2026, 2, 1)), ("1", "b", D(2026, 2, 2)), ("2", "c", D(2026, 2, 2))], "company_id string, source_file_id string, arrived_at date")
    assert {r.source_file_id: r.seq for r in V.next_sequences(runs, files).collect()} == {"a": 5, "b": 6, "c": 1}
    v = spark.createDataFrame([("1", D(2026, 1, 1), D(2026, 1, d), str(d)) for d in (5, 15, 25)], "company_id string, fy_start date, voucher_date date, number string")
    span = scope.select("*", F.lit("2026-01-10").cast("date").alias("lo"), F.lit("2026-01-20").cast("date").alias("hi"))
    part = v.where("number = '15'").withColumn("number", F.lit("new"))
    assert sorted(r.number for r in sie.replace_range(v, part, span).collect()) == ["25", "5", "new"]


def test_visibility(spark):
    f = spark.createDataFrame([("1", "RESTRICTED_AML"), ("1", "INTERNAL"), ("2", "INTERNAL")], "company_id string, visibility string")
    mine = spark.createDataFrame([("1",)], "company_id string")
    assert visible_findings(f, aml=False, assignments=mine).count() == 1
    assert visible_findings(f, aml=True).count() == 3
    items = spark.createDataFrame([("client", [5010]), ("client", [7210]), ("internal", [5010])], "audience string, accounts array<int>")
    assert client_safe(items, [7210]).count() == 1
