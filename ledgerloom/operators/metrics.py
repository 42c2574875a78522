"""The 17 key figures with status, change and overview grid.

One wide row per period carries the income lines and the month-end balance lines; each figure is
a column expression on it. Amounts are öre, percentages whole tenths of a percent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money, rates
from ledgerloom.functions.ranges import BALANCE_ORDER

# Figure → (unit, period based, sensitive to accrual maturity, favourable direction).
METRICS: dict[str, tuple[str, bool, bool, str]] = {
    "net_sales": ("SEK", True, False, "higher"),
    "operating_result": ("SEK", True, True, "higher"),
    "operating_margin": ("percent", True, True, "higher"),
    "result_after_financial": ("SEK", True, True, "higher"),
    "profit_margin": ("percent", True, True, "higher"),
    "gross_profit": ("SEK", True, False, "higher"),
    "ebitda": ("SEK", True, True, "higher"),
    "gross_margin": ("percent", True, False, "higher"),
    "personnel_share": ("percent", True, True, "lower"),
    "external_cost_share": ("percent", True, True, "lower"),
    "equity_ratio": ("percent", False, False, "higher"),
    "quick_ratio": ("percent", False, False, "higher"),
    "current_ratio": ("percent", False, False, "higher"),
    "working_capital": ("SEK", False, False, "neutral"),
    "cash": ("SEK", False, False, "higher"),
    "receivables": ("SEK", False, False, "neutral"),
    "payables": ("SEK", False, False, "neutral"),
}
# The figures shown in the overview.
CORE_METRICS = (
    "net_sales",
    "operating_result",
    "operating_margin",
    "result_after_financial",
    "gross_margin",
    "personnel_share",
    "equity_ratio",
    "quick_ratio",
    "cash",
)

#: numerator / denominator of each ratio, over the wide row (``bs_`` = balance side).
RATIOS: dict[str, tuple[str, str]] = {
    "operating_margin": ("operating_result", "net_sales"),
    "profit_margin": ("result_after_financial", "net_sales"),
    "gross_margin": ("net_sales + materials", "net_sales"),
    "personnel_share": ("-personnel", "net_sales"),
    "external_cost_share": ("-other_external", "net_sales"),
    "equity_ratio": (
        "CAST(bs_total_equity AS DECIMAL(38,0)) * 10000 + CAST(bs_untaxed_reserves AS DECIMAL(38,0)) * (10000 - tax)",
        "CAST(bs_total_assets AS DECIMAL(38,0)) * 10000",
    ),
    "quick_ratio": ("bs_current_assets - bs_inventory", "bs_current_liabilities"),
    "current_ratio": ("bs_current_assets", "bs_current_liabilities"),
}
AMOUNTS: dict[str, str] = {
    "net_sales": "net_sales",
    "operating_result": "operating_result",
    "result_after_financial": "result_after_financial",
    "gross_profit": "net_sales + materials",
    "ebitda": "operating_result - depreciation",
    "working_capital": "bs_current_assets - bs_current_liabilities",
    "cash": "bs_cash_accounts",
    "receivables": "bs_customer_receivables",
    "payables": "bs_payables",
}


def account_group_balances(balances: DataFrame) -> DataFrame:
    """Month-end balance of cash and bank, customer receivables and payables, by account number."""
    a, b = F.col("account"), F.col("balance")
    return balances.groupBy("company_id", "month").agg(
        F.sum(F.when(a.between(1900, 1999), b).otherwise(0)).alias("cash_accounts"),
        F.sum(F.when(a.between(1500, 1599), b).otherwise(0)).alias("customer_receivables"),
        F.sum(F.when(a.between(2440, 2449), -b).otherwise(0)).alias("payables"),
    )


def figure_base(income: DataFrame, balance: DataFrame, groups: DataFrame) -> DataFrame:
    """Income wide rows joined with the balance at the period's last month."""
    extra = ["cash_accounts", "customer_receivables", "payables"]
    b = balance.join(groups, ["company_id", "month"], "left").select(
        "company_id",
        F.col("month").alias("end_month"),
        "balance_complete",
        *[F.col(c).alias("bs_" + c) for c in BALANCE_ORDER],
        *[F.coalesce(F.col(c), F.lit(0)).alias("bs_" + c) for c in extra],
    )
    return (
        income.withColumn("end_month", F.trunc("end", "MM"))
        .join(b, ["company_id", "end_month"], "left")
        .withColumn("tax", rates.rate_per_10000("corporate_tax", F.col("end")))
    )


def key_figures(base: DataFrame, codes: tuple[str, ...] = tuple(METRICS), maturity: DataFrame | None = None) -> DataFrame:
    """Long table: company, period, figure, unit, value, status.

    Status: INSUFFICIENT_DATA without coverage (or, for balance figures, without a complete
    balance), NOT_APPLICABLE on a zero denominator, PARTIAL for accrual-sensitive figures of single
    months of companies that accrue little, else CALCULATED. ``maturity``: company_id, month,
    low_periodization.
    """
    df = base
    low = F.lit(False)
    if maturity is not None:
        m = maturity.select("company_id", F.col("month").alias("end_month"), F.col("low_periodization").alias("low"))
        df = df.join(m, ["company_id", "end_month"], "left")
        low = F.coalesce("low", F.lit(False)) & (F.col("kind") == "month")
    entries = []
    for code in codes:
        unit, period_based, sensitive, _better = METRICS[code]
        raw = F.expr(AMOUNTS[code]) if code in AMOUNTS else F.expr(money.ratio_half_up(*RATIOS[code]))
        usable = F.col("has_data") if period_based else F.col("has_data") & F.coalesce("balance_complete", F.lit(False))
        value = F.when(usable, raw)
        status = F.when(~usable, "INSUFFICIENT_DATA").when(value.isNull(), "NOT_APPLICABLE")
        if sensitive:
            status = status.when(low, "PARTIAL")
        entries.append(
            F.struct(
                F.lit(code).alias("metric"),
                F.lit(unit).alias("unit"),
                value.cast("bigint").alias("value"),
                status.otherwise("CALCULATED").alias("status"),
            )
        )
    return df.select("company_id", "kind", "period", F.inline(F.array(*entries)))


def figure_changes(pairs: DataFrame, figures: DataFrame) -> DataFrame:
    """Change per figure: öre or tenths of a percentage point, and change in 0.1 % for amounts.

    Null unless both sides are usable.
    """
    prev = figures.select(
        "company_id",
        F.col("period").alias("compare"),
        "metric",
        F.col("value").alias("previous"),
        F.col("status").alias("previous_status"),
    )
    usable = "status IN ('CALCULATED', 'PARTIAL') AND previous_status IN ('CALCULATED', 'PARTIAL')"
    return (
        pairs.select("company_id", "period", "compare")
        .join(figures, ["company_id", "period"])
        .join(prev, ["company_id", "compare", "metric"])
        .withColumn("change", F.expr(f"CASE WHEN {usable} THEN value - previous END"))
        .withColumn("change_unit", F.expr("CASE WHEN unit = 'percent' THEN 'pp' ELSE unit END"))
        .withColumn(
            "change_pct",
            F.expr(f"CASE WHEN {usable} AND unit = 'SEK' THEN {money.pct_change('value', 'previous')} END"),
        )
    )
