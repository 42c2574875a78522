"""Dated parameters (tax and VAT rates) and their lookup on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rates by code with their validity (open end = still valid).
RATES: tuple[tuple[str, str, str, str | None], ...] = (
    ("corporate_tax", "0.206", "2021-01-01", None),
    ("vat_rates_allowed", "0.25,0.12,0.06,0", "1990-01-01", None),
    ("vat_food", "0.12", "1996-01-01", "2026-03-31"),
    ("vat_food", "0.06", "2026-04-01", "2027-12-31"),
    ("vat_food", "0.12", "2028-01-01", None),
    ("employer_contribution_full", "0.3142", "2015-01-01", None),
    ("employer_contribution_youth", "0.2081", "2026-04-01", "2027-09-30"),
    ("employer_contribution_pension_only", "0.1021", "2015-01-01", None),
    ("tax_allocation_reserve_years", "6", "2021-01-01", None),
)


def rates_table(spark: SparkSession) -> DataFrame:
    """The rates as a table, for joins against company-specific or changed rates."""
    rows = ", ".join(
        f"('{c}', '{v}', DATE'{a}', {'NULL' if b is None else f'DATE{chr(39)}{b}{chr(39)}'})" for c, v, a, b in RATES
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(code, value, valid_from, valid_to)")


def rate_on(code: str, day: Column, rates: tuple = RATES) -> Column:
    """Text value of a rate on a day, first match in table order; NULL when none is valid.

    The dated table is tiny and fixed at plan time, so the as-of lookup is a CASE expression that
    stays in the scan's generated code instead of a range join.
    """
    out = None
    for c, value, lo, hi in rates:
        if c != code:
            continue
        cond = day >= F.lit(lo).cast("date")
        if hi is not None:
            cond = cond & (day <= F.lit(hi).cast("date"))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if out is None:
        raise KeyError(code)
    return out


def rate_per_10000(code: str, day: Column, rates: tuple = RATES) -> Column:
    """A single-valued rate in ten-thousandths (0.206 → 2060), for integer arithmetic."""
    return F.round(rate_on(code, day, rates).cast("decimal(10,4)") * 10000).cast("bigint")


def as_of(df: DataFrame, rates: DataFrame, code: str, day: str) -> DataFrame:
    """Adds ``value`` of the rate valid on ``day`` from a rates table (dated join).

    One code's rates are a handful of dated rows; Spark picks the broadcast from their size.
    """
    r = rates.where(F.col("code") == code).select("value", "valid_from", "valid_to")
    cond = (F.col(day) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(day) <= F.col("valid_to")))
    return df.join(r, cond, "left").drop("valid_from", "valid_to")
