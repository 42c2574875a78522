"""Column contracts of the ledger tables.

``vouchers`` is nested: one record per voucher with its rows in an array. Everything that looks
at a single voucher (balance, pattern tags, VAT ratio, content hash …) is then a projection
without a shuffle. A voucher comes from one source file, which bounds the array.
"""

from __future__ import annotations

from pyspark.sql import types as T

OBJECT = T.StructType([T.StructField("dim", T.StringType()), T.StructField("obj", T.StringType())])

ROW = T.StructType(
    [
        T.StructField("account", T.IntegerType()),
        T.StructField("amount", T.LongType()),  # öre, debit +, credit −
        T.StructField("trans_date", T.DateType()),
        T.StructField("text", T.StringType()),
        T.StructField("quantity", T.DecimalType(18, 4)),
        T.StructField("objects", T.ArrayType(OBJECT)),
        T.StructField("status", T.StringType()),  # normal | added | removed
        T.StructField("source_line", T.IntegerType()),
    ]
)

VOUCHERS = T.StructType(
    [
        T.StructField("company_id", T.StringType()),
        T.StructField("fy_start", T.DateType()),
        T.StructField("series", T.StringType()),
        T.StructField("number", T.StringType()),
        T.StructField("voucher_date", T.DateType()),
        T.StructField("reg_date", T.DateType()),
        T.StructField("text", T.StringType()),
        T.StructField("rows", T.ArrayType(ROW)),
    ]
)

COMPANIES = (
    "company_id string, name string, org_number string, legal_form string, vat_period string, food_retail boolean, "
    "materiality bigint, has_overdraft boolean, manual_series array<string>, suspense_accounts array<int>"
)
ACCOUNTS = "company_id string, account int, name string, type string, sru string"
FISCAL_YEARS = (
    "company_id string, fy_start date, fy_end date, has_vouchers boolean, opening_status string, "
    "covered_months array<date>"
)
YEAR_BALANCES = "company_id string, fy_start date, kind string, account int, amount bigint"
PERIOD_AMOUNTS = "company_id string, fy_start date, kind string, month date, account int, amount bigint"
FINDINGS = (
    "company_id string, fingerprint string, rule_code string, severity string, period string, visibility string, "
    "status string, vouchers array<string>, accounts array<int>, amount bigint, seen_in_reviews array<string>, "
    "resolution_note string, resolved_by string, resolved_at timestamp"
)
