"""Round trips that go over their lines no more often than they must."""

from __future__ import annotations

import datetime
import json

from ledgerloom.schema import VOUCHERS
from ledgerloom.sources import sie, standard

DAY = datetime.date


def test_all_issues_of_a_record_in_one_pass(spark, tmp_path):
    rows = lambda a, b: [(1930, a, None, None, None, None, "normal", None), (3001, b, None, "å", None, None, "normal", None)]
    given = [("1", DAY(2025, 1, 1), "A", "1", DAY(2025, 1, 31), None, "t", rows(5, -5)), ("1", DAY(2025, 1, 1), "A", "2", DAY(2027, 1, 31), None, "t", rows(5, -4))]
    standard.write_standard(spark.createDataFrame(given, VOUCHERS).coalesce(1), f"{tmp_path}/out")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out", recursiveFileLookup=True).collect()]
    lines[0 if lines[0]["number"] == "2" else 1]["text"] = "other"
    odd = dict(lines[0], number="3", rows=[dict(lines[0]["rows"][0], amount="1.234")])
    spark.createDataFrame([(json.dumps(x),) for x in (*lines, odd)] + [("{broken",)], "value string").coalesce(1).write.text(f"{tmp_path}/bad")
    vouchers, issues = standard.read_standard(spark, f"{tmp_path}/bad")
    assert sorted((r.voucher or "", r.code) for r in issues.collect()) == [
        ("", "INVALID_RECORD"), ("A2", "CONTENT_HASH_MISMATCH"), ("A2", "UNBALANCED_VOUCHER"), ("A2", "VOUCHER_OUTSIDE_YEAR"), ("A3", "INVALID_RECORD"),
    ]
    assert sorted(r.number for r in vouchers.collect()) == ["1", "2"]
    assert issues._jdf.queryExecution().executedPlan().toString().count("FileScan json") == 1


def test_years_are_assumed_only_for_files_without_one(spark, monkeypatch):
    kept, write = {}, sie.stage
    monkeypatch.setattr(sie, "stage", lambda df, name, **more: kept.setdefault(name, write(df, name, **more)))
    texts = {
        "a": ["#FNAMN A", "#RAR 0 20250701 20260630", '#VER "A" 1 20250801 "x"', "{", "#TRANS 1930 {} 5.00", "}"],
        "b": ['#FNAMN "B \\"q\\" AB"', '#VER "A" "7" 20240201 "y"', "{", '#TRANS 1930 {1 "10"} 5,50 20240202 "rad" 2', "}", '#VER A 8 20250301', "{", "}"],
    }
    lines = spark.createDataFrame([(f, n, line) for f, held in texts.items() for n, line in enumerate(held, 1)], "file string, line_no int, line string")
    out = sie.parse_lines(lines)
    years = {(r.file, r.year_no): (r.fy_start, r.fy_end) for r in out.fiscal_years.collect()}
    assert years == {("a", 0): (DAY(2025, 7, 1), DAY(2026, 6, 30)), ("b", 0): (DAY(2024, 1, 1), DAY(2025, 12, 31))}
    assert [r.file for r in kept["sie_undeclared"].collect()] == ["b"]
    got = {(r.file, r.number): [(x.account, x.amount, x.text, len(x.objects)) for x in r.rows] for r in out.vouchers.collect()}
    assert got == {("a", "1"): [(1930, 500, None, 0)], ("b", "7"): [(1930, 550, "rad", 1)], ("b", "8"): []}
    assert {r.name for r in out.companies.collect()} == {"A", 'B "q" AB'}
