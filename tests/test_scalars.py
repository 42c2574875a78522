"""Parsing, labels and formats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import masking
from ledgerloom.functions import scalars as X
from ledgerloom.functions.counterparty import counterparty, read_text
from ledgerloom.operators.voucher_facts import business_days


def _map(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.coalesce(1).orderBy("i").select(fn(F.col("v"))).collect()]


def test_amounts(spark):
    given = {
        "1 234,50": 123450, "1.234,50": 123450, "1,234.50": 123450, "500-": -50000, "(500)": -50000, "−12,5": -1250,
        "100 kr": 10000, "100 SEK": 10000, "1.234.567": 123456700, "12.5": 1250, "+7": 700, "": None, "-": None, "abc": None, "1 000:-": 100000,
    }
    assert _map(spark, X.parse_amount, list(given)) == list(given.values())


def test_days(spark):
    d = dt.date
    given = {
        "2026-01-05": d(2026, 1, 5), "20260105": d(2026, 1, 5), "5.1.2026": d(2026, 1, 5), "2026-01-05 10:00": d(2026, 1, 5),
        "46027": d(2026, 1, 5), "2026-13-01": None, "": None, "x": None,
    }
    assert _map(spark, X.parse_day, list(given)) == list(given.values())


def test_accounts_and_vouchers(spark):
    assert _map(spark, X.parse_account, ["1930 Företagskonto", "1930", "12", "konto"]) == [1930, 1930, None, None]
    assert _map(spark, X.account_label, ["1930 Företagskonto", "1930"]) == ["Företagskonto", None]
    assert _map(spark, X.voucher_series, ["a-12", "12", "VER 7"]) == ["A", "", "VER"]
    assert _map(spark, X.voucher_number, ["a-12", "12", "VER 7"]) == ["12", "12", "7"]


def test_formats(spark):
    nb, minus = "\u00a0", "\u2212"
    got = _map(spark, X.format_sek, [124_000_000, 41_230_000, 845_000, -5_000, 0], "bigint")
    assert got == [f"1,24{nb}Mkr", f"412{nb}tkr", f"8{nb}450{nb}kr", f"{minus}50{nb}kr", f"0{nb}kr"]
    assert _map(spark, X.format_percent, [83, -5], "bigint") == [f"8,3{nb}%", f"{minus}0,5{nb}%"]
    assert _map(spark, X.allocation_year, ["Fond Tax 2020", "Periodiseringsfond 2021", "Fond"]) == [2019, 2021, None]


def test_business_days_against_counting(spark):
    a = dt.date(2026, 1, 1)
    pairs = [(a + dt.timedelta(i), a + dt.timedelta(i + j)) for i in range(8) for j in range(-2, 20)]
    want = [sum(1 for k in range(1, (y - x).days + 1) if (x + dt.timedelta(k)).weekday() < 5) for x, y in pairs]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, a date, b date").coalesce(1).orderBy("i")
    assert [r[0] for r in df.select(business_days(F.col("a"), F.col("b"))).collect()] == want


def test_counterparties(spark):
    rows = spark.createDataFrame(
        [("1", "", "Leverantörsfaktura Åkes Bygg AB nr 12345"), ("2", "Swish: Kiosken", "Diverse"), ("3", "", "Diverse utlägg"), ("4", "", "Telia Sverige AB 2026-01")],
        "company_id string, r_text string, v_text string",
    )
    al = spark.createDataFrame([(None, "telia", "Telia Company"), (None, "telia", "Telia Koncern"), ("4", "telia", "Telia Egen"), ("4", "telia", "Telia Egna")], "company_id string, key string, canonical_name string")
    found = counterparty(read_text(read_text(rows, "r_text", "r_"), "v_text", "v_"), al).collect()
    assert len(found) == 4  # aliases with the same key do not repeat rows
    got = {r.company_id: (r.cp_key, r.cp_confidence) for r in found}
    assert got == {"1": ("akes bygg", 75), "2": ("kiosken", 75), "3": ("okänd motpart", 10), "4": ("telia egen", 98)}


def test_masking_is_reversible(spark):
    text = "Kalle 640823-3234, kalle@ex.se och 070-123 45 67; kalle@ex.se igen, 640823-3235 är fel. Kalle!"
    row = masking.mask(spark.createDataFrame([(text, ["Kalle", "K", None])], "t string, known array<string>"), "t", "known").select("masked", masking.unmask(F.col("masked"), F.col("mapping")).alias("back")).first()
    assert row.masked == "PERSON_1 PNR_1, EMAIL_1 och TEL_1; EMAIL_1 igen, 640823-3235 är fel. PERSON_1!"
    assert row.back == text
