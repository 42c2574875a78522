"""VAT and payroll controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ranges as R
from ledgerloom.functions.rates import rate_on
from ledgerloom.operators import ledger as L
from ledgerloom.operators.controls.base import Context, control, finding


def _with_vat_bounds(df: DataFrame) -> DataFrame:
    """Adds the highest and lowest positive VAT rate valid on the voucher date, in 1/10000."""
    allowed = F.transform(
        F.split(rate_on("vat_rates_allowed", F.col("voucher_date")), ","),
        lambda x: F.round(F.trim(x).cast("decimal(10,4)") * 10000).cast("bigint"),
    )
    return df.withColumn("allowed", F.filter(allowed, lambda x: x > 0)).withColumn("vat_max", F.array_max("allowed")).withColumn("vat_min", F.array_min("allowed"))


@control("INPUT_VAT_RATIO")
def input_vat(ctx: Context) -> DataFrame:
    tol = ctx.param("INPUT_VAT_RATIO", "tolerance_bp")
    v = _with_vat_bounds(ctx.facts.where("input_vat > 0 AND cost_base > 0"))
    rate = F.col("input_vat") * 10000
    base = F.col("cost_base")
    problem = (
        F.when(F.col("exempt_only"), "exempt")
        .when(rate > (F.col("vat_max") + tol) * base, "high")
        .when((rate < (F.col("vat_min") - tol) * base) & (F.col("input_vat") * 1000 > base * 5), "low")
    )
    hits = v.withColumn("problem", problem).where("problem IS NOT NULL")
    accs = F.array_sort(
        F.array_distinct(
            F.transform(
                F.filter(
                    "eff",
                    lambda r: ((R.COSTS.on(r["account"]) | r["account"].between(1100, 1499)) & (r["amount"] > 0)) | R.INPUT_VAT.on(r["account"]),
                ),
                lambda r: r["account"],
            )
        )
    )
    return finding(
        hits,
        "INPUT_VAT_RATIO",
        review=F.col("month"),
        key=[F.col("voucher"), F.col("voucher_date")],
        severity=F.when(F.col("problem") == "high", "HIGH").otherwise("MEDIUM"),
        vouchers=F.array("voucher"),
        accounts=accs,
        amount=F.col("input_vat"),
        variant=F.col("problem"),
    )


@control("OUTPUT_VAT_RATIO")
def output_vat(ctx: Context) -> DataFrame:
    """Too high output VAT per voucher, and 12 % VAT booked after the food rate was cut to 6 %."""
    tol = ctx.param("OUTPUT_VAT_RATIO", "tolerance_bp")
    v = _with_vat_bounds(ctx.facts.where("output_vat > 0 AND sales_base > 0"))
    high = finding(
        v.where(F.col("output_vat") * 10000 > (F.col("vat_max") + tol) * F.col("sales_base")),
        "OUTPUT_VAT_RATIO",
        review=F.col("month"),
        key=[F.col("voucher")],
        severity=F.lit("HIGH"),
        vouchers=F.array("voucher"),
        amount=F.col("output_vat"),
        variant=F.lit("high"),
    )
    food = (
        v.where("has_vat_12")
        .where(rate_on("vat_food", F.col("voucher_date")) == "0.06")
        .join(ctx.companies.where("food_retail").select("company_id"), "company_id", "left_semi")
    )
    w = Window.partitionBy("company_id", "month").orderBy("voucher_date", "voucher")
    first = (
        food.withColumn("rk", F.row_number().over(w))
        .where("rk <= 20")
        .groupBy("company_id", "month")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "voucher"))), lambda s: s["voucher"]).alias("vouchers"))
    )
    accs = food.select("company_id", "month", F.explode("eff").alias("r")).where(R.OUTPUT_VAT_12.on(F.col("r.account")))
    total = accs.groupBy("company_id", "month").agg((-F.sum("r.amount")).alias("vat12"), F.array_sort(F.collect_set("r.account")).alias("accounts"))
    cut = finding(
        total.join(first, ["company_id", "month"]),
        "OUTPUT_VAT_RATIO",
        review=F.col("month"),
        key=[F.lit("food_vat"), F.date_format("month", "yyyy-MM")],
        vouchers=F.col("vouchers"),
        accounts=F.col("accounts"),
        amount=F.col("vat12"),
        variant=F.lit("food"),
    )
    return high.unionByName(cut)


@control("VAT_ACCOUNTS_NOT_CLEARED")
def vat_not_cleared(ctx: Context) -> DataFrame:
    """Residual on the VAT accounts at the last four VAT period ends before the grace limit."""
    tol = ctx.param("VAT_ACCOUNTS_NOT_CLEARED", "tolerance")
    grace = ctx.param("VAT_ACCOUNTS_NOT_CLEARED", "grace_days")
    step = F.expr("CASE vat_period WHEN 'month' THEN 1 WHEN 'year' THEN 12 ELSE 3 END")
    month = ctx.coverage.join(ctx.companies.select("company_id", step.alias("step")), "company_id")
    offset = F.expr("CAST(months_between(month, trunc(fy_start, 'MM')) AS INT) + 1")
    ends = month.where(offset % F.col("step") == 0).select("company_id", F.col("month").alias("vat_month"))
    reviews = ctx.coverage.where("covered").select("company_id", F.col("month").alias("review_month"))
    # Period ends are counted in order of time; a review looks at the last four that are due.
    none = F.lit(None).cast("date")
    dated = ends.select("company_id", F.last_day("vat_month").alias("day"), "vat_month", none.alias("review_month")).unionByName(
        reviews.select("company_id", F.date_sub(F.last_day("review_month"), grace).alias("day"), none.alias("vat_month"), "review_month")
    )
    upto = Window.partitionBy("company_id").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = dated.withColumn("rk", F.count("vat_month").over(upto))
    last_four = counted.where("review_month IS NOT NULL AND rk > 0").select("company_id", "review_month", F.explode(F.sequence(F.greatest(F.col("rk") - 3, F.lit(1)), F.col("rk"))).alias("rk"))
    due = last_four.join(counted.where("vat_month IS NOT NULL").select("company_id", "vat_month", "rk"), ["company_id", "rk"])
    residual = (
        ctx.balances.where(R.VAT_ACCOUNTS.on(F.col("account")) & (F.abs("balance") > tol))
        .groupBy("company_id", F.col("month").alias("vat_month"))
        .agg(F.sum("balance").alias("total"), F.array_sort(F.collect_set("account")).alias("accounts"))
    )
    hits = due.join(residual, ["company_id", "vat_month"])
    return finding(
        hits,
        "VAT_ACCOUNTS_NOT_CLEARED",
        review=F.col("review_month"),
        key=[F.last_day("vat_month")],
        period=F.date_format("vat_month", "yyyy-MM"),
        accounts=F.col("accounts"),
        amount=F.col("total"),
    )


@control("PAYROLL_TAX_NOT_CLEARED")
def payroll_tax(ctx: Context) -> DataFrame:
    """Debt on withheld tax / contributions larger than what the month itself explains."""
    pct = ctx.param("PAYROLL_TAX_NOT_CLEARED", "tolerance_pct")
    least = ctx.param("PAYROLL_TAX_NOT_CLEARED", "tolerance_min")
    group = lambda c: F.when(c.between(2710, 2719), "Personalskatt").when(c.between(2730, 2739), "Arbetsgivaravgifter")
    debt = (
        ctx.balances.withColumn("label", group(F.col("account")))
        .where("label IS NOT NULL")
        .groupBy("company_id", "month", "label")
        .agg((-F.sum("balance")).alias("debt"), F.array_sort(F.collect_set("account")).alias("accounts"))
    )
    credits = (
        ctx.facts.select("company_id", "month", F.explode("eff").alias("r"))
        .withColumn("label", group(F.col("r.account")))
        .where("label IS NOT NULL AND r.amount < 0")
        .groupBy("company_id", "month", "label")
        .agg((-F.sum("r.amount")).alias("credits"))
    )
    hits = (
        debt.join(ctx.coverage.where("covered").select("company_id", "month"), ["company_id", "month"], "left_semi")
        .join(credits, ["company_id", "month", "label"], "left")
        .withColumn("credits", F.coalesce("credits", F.lit(0)))
        .where(F.col("debt") * 100 > F.col("credits") * (100 + pct) + least * 100)
    )
    return finding(
        hits,
        "PAYROLL_TAX_NOT_CLEARED",
        review=F.col("month"),
        key=[F.col("label"), F.date_format("month", "yyyy-MM")],
        accounts=F.col("accounts"),
        amount=F.col("debt") - F.col("credits"),
    )


@control("EMPLOYER_CONTRIBUTION_RATIO")
def employer_contribution(ctx: Context) -> DataFrame:
    """Contributions / wages against the median of up to six months with wages, else the full rate."""
    dev = ctx.param("EMPLOYER_CONTRIBUTION_RATIO", "max_deviation_pp") / 100
    a = F.col("account")
    flow = ctx.movements.groupBy("company_id", "month").agg(
        F.sum(F.when(R.SALARY_BASE.on(a), F.col("amount")).otherwise(0)).alias("base"),
        F.sum(F.when(R.EMPLOYER_CONTRIB.on(a), F.col("amount")).otherwise(0)).alias("contrib"),
    )
    paid = flow.where("base > 0").withColumn("ratio", F.col("contrib").cast("double") / F.col("base").cast("double"))
    past = (
        L.history_months(ctx.coverage, 6)
        .join(paid.select("company_id", "month", "ratio"), ["company_id", "month"])
        .groupBy("company_id", "anchor")
        .agg(F.array_sort(F.collect_list("ratio")).alias("hist"))
    )
    full = rate_on("employer_contribution_full", F.last_day("month")).cast("double")
    mid = F.expr("(hist[CAST((size(hist) - 1) div 2 AS INT)] + hist[CAST(size(hist) div 2 AS INT)]) / 2")
    j = (
        paid.join(ctx.coverage.where("covered").select("company_id", "month"), ["company_id", "month"], "left_semi")
        .join(past.withColumnRenamed("anchor", "month"), ["company_id", "month"], "left")
        .withColumn("full", full)
        .withColumn("expected", F.when(F.coalesce(F.size("hist"), F.lit(0)) >= 3, mid).otherwise(F.col("full")))
    )
    problem = (
        F.when(F.col("contrib") == 0, "none")
        .when(F.col("ratio") > F.col("full") + 0.01, "above_full")
        .when(F.abs(F.col("ratio") - F.col("expected")) > dev, "deviates")
    )
    return finding(
        j.withColumn("problem", problem).where("problem IS NOT NULL"),
        "EMPLOYER_CONTRIBUTION_RATIO",
        review=F.col("month"),
        key=[F.date_format("month", "yyyy-MM")],
        severity=F.when(F.col("contrib") == 0, "HIGH").otherwise("MEDIUM"),
        accounts=F.array(F.lit(7510)),
        amount=F.col("contrib"),
        variant=F.col("problem"),
    )
