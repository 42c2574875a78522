"""Ingest jobs on small hand-written files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.sources import files as SF
from ledgerloom.sources import sie, standard, tabular

SIE_TEXT = """#FLAGGA 0
#FORMAT PC8
#SIETYP 4
#FNAMN "Prov Åkeri AB"
#ORGNR 556111-2222
#RAR 0 20260101 20261231
#RAR -1 20250101 20251231
#KONTO 1510 "Kundfordringar"
#KTYP 1510 T
#KONTO 1930 "Företagskonto"
#KONTO 3001 "Försäljning"
#KONTO 6110 "Kontorsmateriel"
#IB 0 1930 1000.00
#UB -1 1930 1000.00
#RES -1 3001 -500.00
#PSALDO 0 202601 3001 {} -400.00
#PSALDO 0 202601 3001 {1 "10"} -100.00
#VER A 1 20260105 "Faktura \\"Kund\\""
{
   #TRANS 1510 {} 500.00
   #TRANS 3001 {1 "10"} -500.00 20260106 "Tjänst"
}
#VER A 2 20260128 "Rättad" 20260130
{
   #BTRANS 6110 {} 500.00
   #RTRANS 6110 {} 400.00 20260128 "Rätt"
   #TRANS 6110 {} 400.00
   #TRANS 1930 {} -400.00
}
#TRANS 1930 {} 1.00
#VER A 3 20270105 "Fel"
{
   #TRANS 6993 {} 100.00
   #TRANS 1930 {} -99.00
}
"""


def _files(spark, **texts):
    rows = [(n, t if isinstance(t, bytes) else t.encode("utf-8"), "55") for n, t in texts.items()]
    return spark.createDataFrame(rows, "file string, content binary, company_id string")


def test_decode_prefers_plausible_swedish():
    assert SF.decode("Försäljning åäö".encode("cp437")) == "Försäljning åäö"
    assert SF.decode("Försäljning åäö".encode("cp1252")) == "Försäljning åäö"
    assert SF.decode("﻿För".encode()) == "För"


def test_delimiter(spark):
    texts = {"semi": ["a;b;c", "1,5;2;3"], "tab": ["a\tb", "1\t2"], "quoted": ['"a,b,c,d";e', '"f,g";h'], "late": ["x"] * 300 + ["a|b|c"] * 2, "none": ["x"]}
    lines = spark.createDataFrame([(f, i, t) for f, ts in texts.items() for i, t in enumerate(ts)], "file string, line_no int, line string")
    assert {r.file: r.delimiter for r in SF.delimiters(lines).collect()} == {"semi": ";", "tab": "\t", "quoted": ";", "late": "|"}


def test_utf16_files_keep_their_kind(spark):
    files = _files(spark, s=SIE_TEXT.encode("utf-16"), j='{"format": 1}'.encode("utf-16"), c="Vernr;Datum\n".encode("utf-16"), late=(" " * 9000 + "\n" + SIE_TEXT).encode())
    assert {r.file: r.source_kind for r in SF.with_kind(files).collect()} == {"s": "sie", "j": "json", "c": "csv", "late": "sie"}
    assert sie.read_sie(files.where("file = 's'").select("file", "content")).vouchers.count() == 3


def test_every_bad_record_is_an_issue(spark):
    text = (
        "#FLAGGA 0\n#KONTO 1930 Bank\n#KONTO x Bad\n#IB 0 1930 abc\n#RES 0 x 5.00\n#PSALDO 0 202613 3001 {} 5.00\n#WHAT 1\n#WHAT 2\n{\n"
        "#VER A 1 20261399\n{\n#TRANS 1930 {} 5.00\n}\n#VER A 2 20260101\n{\n#TRANS 1930 {} 0.00\n#KONTO 1931 Kassa\n}\n#VER A 3 20260102\n{\n#TRANS 1930 {} 0.00\n"
    )
    t = sie.read_sie(_files(spark, a=text).select("file", "content"))
    codes = sorted((r.code, r.line_no) for r in t.issues.collect())
    assert codes == sorted(
        [("INVALID_RECORD", n) for n in (3, 4, 5, 6, 10)]
        + [("UNKNOWN_LABEL", 7), ("UNEXPECTED_BRACE", 9), ("ORPHAN_TRANS", 12), ("UNCLOSED_VOUCHER", 17), ("UNEXPECTED_BRACE", 18), ("UNCLOSED_VOUCHER", 19), ("MISSING_RAR", None)],
        key=lambda c: (c[0], c[1] or 0),
    )
    assert sorted(r.number for r in t.vouchers.collect()) == ["2", "3"]


def test_late_header_wide_rows_and_missing_header(spark):
    filler = "".join(f"Rad {i};;\n" for i in range(60))
    wide = ";".join(["x"] * 230)
    late = f"{filler}{wide};Vernr;Datum;Konto;Belopp\n{wide};A1;2026-01-05;1930;5\n{wide};A1;2026-01-05;3001;-5\n"
    t = tabular.read_tabular(_files(spark, late=late, bare="bara text\noch mer\n", empty=b""), _known(spark))
    v = t.vouchers.collect()
    assert [(x.series, x.number, [(r.account, r.amount) for r in x.rows]) for x in v] == [("A", "1", [(1930, 500), (3001, -500)])]
    assert sorted((r.file, r.code) for r in t.issues.collect()) == [("bare", "NO_HEADER"), ("empty", "NO_HEADER")]


def test_sie_tables(spark):
    t = sie.read_sie(_files(spark, a=SIE_TEXT.encode("cp437")).select("file", "content"))
    company = t.companies.first()
    assert (company.company_id, company.name, company.sie_type) == ("5561112222", "Prov Åkeri AB", 4)
    v = {r.number: r for r in t.vouchers.collect()}
    assert v["1"].text == 'Faktura "Kund"' and v["1"].voucher_date == dt.date(2026, 1, 5)
    assert v["1"].rows[1].objects[0].asDict() == {"dim": "1", "obj": "10"} and v["1"].rows[1].text == "Tjänst"
    two = [(r.account, r.amount, r.status) for r in v["2"].rows]
    assert two == [(6110, 50000, "removed"), (6110, 40000, "added"), (1930, -40000, "normal")]
    assert v["2"].reg_date == dt.date(2026, 1, 30)
    years = {r.year_no: r for r in t.fiscal_years.collect()}
    assert years[0].has_vouchers and not years[-1].has_vouchers
    balances = {(r.kind, r.account): r.amount for r in t.year_balances.collect()}
    assert balances == {("IB", 1930): 100000, ("UB", 1930): 100000, ("RES", 3001): -50000}
    assert [(r.kind, r.amount) for r in t.period_amounts.collect()] == [("PSALDO", -40000)]
    codes = sorted(r.code for r in t.issues.collect())
    assert codes == ["ORPHAN_TRANS", "UNBALANCED_VOUCHER", "UNKNOWN_ACCOUNT", "VOUCHER_OUTSIDE_YEAR"]


def _known(spark):
    return spark.createDataFrame([("55", [(dt.date(2026, 1, 1), dt.date(2026, 12, 31))])], "company_id string, years array<struct<s:date,e:date>>")


def test_flat_list_with_opening_and_sum(spark):
    text = (
        "Företag AB 556111-2222\n\nVernr;Datum;Konto;Benämning;Text;Debet;Kredit\n"
        ";;1930;Bank;Ingående balans;1 000,00;\nA1;2026-01-05;1510;Kund;Faktura;1 250,00;\n"
        "A1;2026-01-05;3001;Sälj;Faktura;;1 000,00\nA1;2026-01-05;2611;Moms;Faktura;;250,00\n;;;;Summa;1 250,00;1 250,00\n"
    )
    t = tabular.read_tabular(_files(spark, a=text), _known(spark))
    v = t.vouchers.first()
    assert (v.series, v.number, v.text) == ("A", "1", "Faktura")
    assert [(r.account, r.amount) for r in v.rows] == [(1510, 125000), (3001, -100000), (2611, -25000)]
    o = t.openings.first()
    assert (o.account, o.amount, o.fy_start) == (1930, 100000, dt.date(2026, 1, 1))
    assert t.issues.count() == 0


def test_grouped_layout_fills_down(spark):
    text = 'Vernr,Datum,Text,Konto,Kontonamn,Debet,Kredit\nA 7,2026-02-01,Hyra,5010,Lokal,"8000,00",\n,,,1930,Bank,,"8000,00"\nB-8,2026-02-02,El,5020,El,100,\n,,,1930,,,100\n'
    t = tabular.read_tabular(_files(spark, a=text), _known(spark))
    got = {(v.series, v.number): [(r.account, r.amount) for r in v.rows] for v in t.vouchers.collect()}
    assert got == {("A", "7"): [(5010, 800000), (1930, -800000)], ("B", "8"): [(5020, 10000), (1930, -10000)]}


def test_general_ledger_layout(spark):
    text = (
        "Konto\tNamn\tVernr\tDatum\tText\tDebet\tKredit\tSaldo\n1930\tBank\t\t\t\t\t\t\n\t\t\t\tIngående saldo\t\t\t500\n"
        "\t\tA1\t2026-03-01\tKöp\t\t100\t400\n6110\tKontor\t\t\t\t\t\t\n\t\tA1\t2026-03-01\tKöp\t100\t\t100\n"
    )
    t = tabular.read_tabular(_files(spark, a=text), _known(spark))
    v = t.vouchers.first()
    assert sorted((r.account, r.amount) for r in v.rows) == [(1930, -10000), (6110, 10000)]
    assert [(r.account, r.amount) for r in t.openings.collect()] == [(1930, 50000)]


def test_bad_rows_become_issues(spark):
    text = "Vernr;Datum;Konto;Text;Belopp\nA1;2026-13-01;1930;x;5\nA1;2026-01-02;abc;x;5\nA2;2026-01-02;1930;x;5\nA2;2026-01-02;3001;x;-4\n"
    t = tabular.read_tabular(_files(spark, a=text), _known(spark))
    codes = sorted(r.code for r in t.issues.collect())
    assert codes == ["INVALID_ROW", "INVALID_ROW", "UNBALANCED_VOUCHER"]


def test_fiscal_years_are_chained(spark):
    years = [(dt.date(2024, 7, 1), dt.date(2025, 6, 30)), (dt.date(2026, 7, 1), dt.date(2027, 6, 30))]
    known = spark.createDataFrame([("55", years)], "company_id string, years array<struct<s:date,e:date>>")
    days = [dt.date(2025, 1, 5), dt.date(2025, 9, 1), dt.date(2028, 8, 1), dt.date(2023, 6, 30)]
    df = spark.createDataFrame([("55", d) for d in days], "company_id string, day date")
    got = {r.day: (r.fy_start, r.fy_end) for r in tabular.assign_fiscal_year(df, known).collect()}
    assert got[days[0]] == years[0]
    assert got[days[1]] == (dt.date(2025, 7, 1), dt.date(2026, 6, 30))
    assert got[days[2]] == (dt.date(2028, 7, 1), dt.date(2029, 6, 30))
    assert got[days[3]] == (dt.date(2022, 7, 1), dt.date(2023, 6, 30))


def test_kinds_and_matching(spark, tmp_path):
    (tmp_path / "a.se").write_bytes(SIE_TEXT.encode("cp437"))
    (tmp_path / "b.csv").write_text("Vernr;Datum\n")
    (tmp_path / "c.json").write_text('{"format": 1}')
    (tmp_path / "d.bin").write_bytes(b"%PDF-1.4")
    kinds = {r.file[-4:]: r.source_kind for r in SF.read_files(spark, str(tmp_path)).collect()}
    assert kinds == {"a.se": "sie", ".csv": "csv", "json": "json", ".bin": "unsupported"}
    companies = spark.createDataFrame([("c1", "556111-2222")], "company_id string, org_number string")
    known = spark.createDataFrame([("c1", "h2")], "company_id string, sha256 string")
    loaded = spark.createDataFrame(
        [("f1", "h1", "5561112222", True), ("f2", "h2", "556111-2222", True), ("f3", "h3", "999", True), ("f4", "h4", None, False)],
        "file string, sha256 string, org_number string, readable boolean",
    )
    got = {r.file: r.status for r in SF.match_companies(loaded, companies, known).collect()}
    assert got == {"f1": "imported", "f2": "duplicate", "f3": "no_match", "f4": "error"}


def test_tax_statement(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Datum;Transaktion;Belopp\n2026-01-12;Moms;−1 234,50\n2026-01-13;Fel;abc\n", encoding="utf-8")
    rows = SF.tax_account_statement(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.date, r.text, r.amount) for r in rows] == [(dt.date(2026, 1, 12), "Moms", -123450)]


def test_standard_round_trip_and_tampering(spark, tmp_path):
    t = sie.read_sie(_files(spark, a=SIE_TEXT.encode("cp437")).select("file", "content"))
    cols = ["company_id", "fy_start", "series", "number", "voucher_date", "reg_date", "text", "rows"]
    standard.write_standard(t.vouchers.select(*cols), str(tmp_path / "out"))
    back, issues = standard.read_standard(spark, str(tmp_path / "out"))
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert key(back) == key(t.vouchers)
    assert {r.code for r in issues.collect()} == {"UNBALANCED_VOUCHER"}
    text = spark.read.text(str(tmp_path / "out")).select(F.regexp_replace("value", '"500.00"', '"501.00"').alias("value"))
    text.write.text(str(tmp_path / "bad"))
    _, bad = standard.read_standard(spark, str(tmp_path / "bad"))
    assert "CONTENT_HASH_MISMATCH" in {r.code for r in bad.collect()}
