"""What a scan along the lines of SIE files carries."""

from __future__ import annotations

import re

from ledgerloom.sources import sie


def test_scanned_lines_are_cut_into_tokens_after_the_scan(spark):
    lines = spark.createDataFrame([("f", 1, '#VER A 1 20260101 "Hyra"'), ("f", 2, "{"), ("f", 3, "#TRANS 5010 {} 100.00"), ("f", 4, "}")], "file string, line_no long, line string")
    rec = sie.records(lines)
    scanned = re.search(r"ReadSchema: struct<([^\n]*)", rec._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "line" not in rec.columns and "tokens" not in scanned
    got = {r.line_no: (r.label, r.voucher_line, len(r.tokens)) for r in rec.collect()}
    assert got[1] == ("#VER", 1, 5) and got[3] == ("#TRANS", 1, 4) and got[2][:2] == ("{", 1)
