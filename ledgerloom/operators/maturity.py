"""Period maturity: how complete a company-month is and how the company accrues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.ranges import DEPRECIATION, FIXED_ASSETS, SALARIES, VACATION
from ledgerloom.operators import ledger as L


def month_activity(facts: DataFrame) -> DataFrame:
    """Vouchers per month and whether customers or suppliers were booked at all (net may be zero)."""
    return facts.groupBy("company_id", "month").agg(
        F.count("*").alias("n_vouchers"),
        F.max("has_customers").alias("recv"),
        F.max("has_suppliers").alias("pay"),
        F.max("voucher_date").alias("last_date"),
    )


def month_flows(movements: DataFrame) -> DataFrame:
    """Net movement of the account groups maturity looks at."""
    a = F.col("account")
    pick = lambda accs: F.sum(F.when(accs.on(a), F.col("amount")).otherwise(0))
    return movements.groupBy("company_id", "month").agg(
        pick(DEPRECIATION).alias("dep"), pick(SALARIES).alias("sal"), pick(VACATION).alias("vac")
    )


def maturity(facts: DataFrame, movements: DataFrame, coverage: DataFrame, balances: DataFrame) -> DataFrame:
    """One row per fiscal month; months without data get NO_DATA.

    History is the last 12 months with data including the month itself. The year-end month is left
    out where regular routines are judged, since yearly entries are booked there.
    """
    month = (
        coverage.where("covered")
        .select("company_id", "month", "source")
        .join(month_activity(facts), ["company_id", "month"], "left")
        .join(month_flows(movements), ["company_id", "month"], "left")
        .na.fill(0, ["n_vouchers", "dep", "sal", "vac"])
        .na.fill(False, ["recv", "pay"])
    )
    hist = L.history_months(coverage, 12, include_anchor=True).join(
        coverage.select("company_id", F.col("month").alias("anchor"), F.trunc("fy_end", "MM").alias("fy_last")),
        ["company_id", "anchor"],
    ).join(month, ["company_id", "month"])
    regular = F.col("month") != F.col("fy_last")
    vouchers = regular & (F.col("source") == "vouchers")
    before = F.sort_array(F.collect_list(F.when(F.col("month") < F.col("anchor"), F.struct("month", "n_vouchers", "sal"))), asc=False)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    h = hist.groupBy("company_id", "anchor").agg(
        count(regular).alias("n_regular"),
        count(vouchers).alias("n_voucher_months"),
        F.greatest(count(vouchers & F.col("recv")), count(vouchers & F.col("pay"))).alias("used"),
        count(regular & (F.col("dep") != 0)).alias("dep_months"),
        count(regular & (F.col("vac") != 0)).alias("vac_months"),
        F.slice(before, 1, 6).alias("recent"),
        F.max(F.when(F.col("month") == F.col("anchor"), F.col("n_vouchers"))).alias("current"),
        F.max(F.when(F.col("month") == F.col("anchor"), F.col("sal"))).alias("sal_now"),
    )
    assets = (
        balances.where(FIXED_ASSETS.on(F.col("account")))
        .groupBy("company_id", F.col("month").alias("anchor"))
        .agg(F.sum("balance").alias("assets"))
    )
    last = month.groupBy("company_id").agg(F.max("last_date").alias("last_date"))
    counts = F.array_sort(F.transform("recent", lambda r: r["n_vouchers"]))
    n = F.size("recent")
    j = (
        h.join(assets, ["company_id", "anchor"], "left")
        .join(last, "company_id")
        .withColumn("counts", counts)
        .withColumn(
            "med2",
            F.when(
                n > 0,
                F.expr("counts[CAST((size(counts) - 1) div 2 AS INT)] + counts[CAST(size(counts) div 2 AS INT)]"),
            ),
        )
        .withColumn(
            "method",
            F.when(F.col("n_voucher_months") < 3, "unknown").when(F.col("used") * 2 >= F.col("n_voucher_months"), "invoice").otherwise("cash"),
        )
        .withColumn(
            "monthly_depreciation",
            F.when((F.coalesce("assets", F.lit(0)) > 0) & (F.col("n_regular") >= 4), F.col("dep_months") * 2 >= F.col("n_regular")),
        )
        .withColumn("has_payroll", F.size(F.filter("recent", lambda r: r["sal"] != 0)) >= 3)
        .withColumn("payroll_booked", F.when(F.col("has_payroll"), F.col("sal_now") != 0))
        .withColumn(
            "monthly_vacation_accrual",
            F.when(F.col("has_payroll") & (F.col("n_regular") >= 4), F.col("vac_months") * 2 >= F.col("n_regular")),
        )
        .withColumn("completeness", F.when(F.coalesce("med2", F.lit(0)) > 0, F.expr(money.ratio_half_even("2 * current", "med2", 100))))
        .withColumn("closed_signal", F.col("last_date") > F.last_day("anchor"))
    )
    no = F.lit(False)
    low = (
        (F.col("method") == "cash")
        | (F.coalesce("monthly_depreciation", F.lit(True)) == no)
        | (F.coalesce("monthly_vacation_accrual", F.lit(True)) == no)
    )
    preliminary = (F.coalesce("payroll_booked", F.lit(True)) == no) | (F.coalesce("completeness", F.lit(100)) < 60)
    judged = j.select(
        "company_id",
        F.col("anchor").alias("month"),
        F.when(preliminary, "PRELIMINARY").otherwise("COMPLETE").alias("status"),
        F.col("method").alias("accounting_method"),
        "monthly_depreciation",
        "monthly_vacation_accrual",
        "payroll_booked",
        F.col("completeness").cast("bigint").alias("completeness"),
        "closed_signal",
        low.alias("low_periodization"),
        F.when(low, "r12").otherwise("month").alias("recommended_view"),
    )
    missing = coverage.where("NOT covered").select(
        "company_id",
        "month",
        F.lit("NO_DATA").alias("status"),
        F.lit("unknown").alias("accounting_method"),
        F.lit(None).cast("boolean").alias("monthly_depreciation"),
        F.lit(None).cast("boolean").alias("monthly_vacation_accrual"),
        F.lit(None).cast("boolean").alias("payroll_booked"),
        F.lit(None).cast("bigint").alias("completeness"),
        no.alias("closed_signal"),
        F.lit(True).alias("low_periodization"),
        F.lit("r12").alias("recommended_view"),
    )
    return judged.unionByName(missing)
