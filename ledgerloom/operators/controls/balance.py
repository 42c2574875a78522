"""Controls on month-end balances and company law."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ranges as R
from ledgerloom.functions.rates import rate_on, rate_per_10000
from ledgerloom.functions.scalars import allocation_year
from ledgerloom.operators import ledger as L
from ledgerloom.operators.controls.base import Context, control, finding

_YM = "yyyy-MM"


def _reviewed(ctx: Context, df: DataFrame) -> DataFrame:
    """Keep months that are reviewed: fiscal months with data."""
    return df.join(ctx.coverage.where("covered").select("company_id", "month"), ["company_id", "month"], "left_semi")


@control("ABNORMAL_SIGN")
def abnormal_sign(ctx: Context) -> DataFrame:
    mat = ctx.companies.select("company_id", "materiality")
    a, last = F.col("account"), F.col("account") % 10
    bal = _reviewed(ctx, ctx.balances.where("account BETWEEN 1000 AND 1999 AND balance < 0")).join(mat, "company_id")
    kind = (
        F.when(R.CASH.on(a), "negative_cash")
        .when(~R.BANK.on(a) & ~last.isin(8, 9) & (F.col("balance") < -F.col("materiality")), "credit_asset")
    )
    assets = finding(
        bal.withColumn("kind", kind).where("kind IS NOT NULL"),
        "ABNORMAL_SIGN",
        review=F.col("month"),
        key=[a, F.col("kind")],
        severity=F.when(F.col("kind") == "negative_cash", "HIGH").otherwise("MEDIUM"),
        accounts=F.array(a),
        amount=F.col("balance"),
        variant=F.col("kind"),
    )
    sales = _reviewed(ctx, ctx.movements.where(R.SALES.on(a) & (F.col("amount") > 0))).join(mat, "company_id").where("amount > materiality")
    revenue = finding(
        sales,
        "ABNORMAL_SIGN",
        review=F.col("month"),
        key=[a, F.lit("debit_revenue"), F.date_format("month", _YM)],
        severity=F.lit("LOW"),
        accounts=F.array(a),
        amount=F.col("amount"),
        variant=F.lit("debit_revenue"),
    )
    return assets.unionByName(revenue)


@control("TAX_ACCOUNT_BALANCE")
def tax_account(ctx: Context) -> DataFrame:
    tol = ctx.param("TAX_ACCOUNT_BALANCE", "tolerance")
    bal = ctx.balances.where(R.TAX_ACCOUNT.on(F.col("account"))).groupBy("company_id", "month").agg(F.sum("balance").alias("balance"))
    return finding(
        _reviewed(ctx, bal.where(F.abs("balance") > tol)),
        "TAX_ACCOUNT_BALANCE",
        review=F.col("month"),
        key=[F.date_format("month", _YM)],
        accounts=F.array(F.lit(1630)),
        amount=F.col("balance"),
    )


@control("SUSPENSE_ACCOUNT_BALANCE")
def suspense(ctx: Context) -> DataFrame:
    tol = ctx.param("SUSPENSE_ACCOUNT_BALANCE", "tolerance")
    extra = ctx.param("SUSPENSE_ACCOUNT_BALANCE", "accounts")
    by_name = ctx.accounts.where(F.lower("name").rlike(ctx.param("SUSPENSE_ACCOUNT_BALANCE", "name_pattern"))).select("company_id", "account")
    chosen = ctx.companies.select("company_id", F.explode(F.array_union("suspense_accounts", F.array(*[F.lit(int(x)) for x in extra]).cast("array<int>"))).alias("account"))
    hits = _reviewed(ctx, ctx.balances.where(F.abs("balance") > tol)).join(by_name.union(chosen).distinct(), ["company_id", "account"], "left_semi")
    return finding(
        hits,
        "SUSPENSE_ACCOUNT_BALANCE",
        review=F.col("month"),
        key=[F.col("account"), F.date_format("month", _YM)],
        accounts=F.array("account"),
        amount=F.col("balance"),
    )


@control("ASSETS_WITHOUT_DEPRECIATION")
def assets_without_depreciation(ctx: Context) -> DataFrame:
    n = ctx.param("ASSETS_WITHOUT_DEPRECIATION", "months_missing")
    gross = (
        ctx.balances.where(R.DEPRECIABLE.on(F.col("account")) & ~(F.col("account") % 10).isin(8, 9))
        .groupBy("company_id", "month")
        .agg(F.sum("balance").alias("gross"))
        .join(ctx.companies.select("company_id", "materiality"), "company_id")
        .where("gross > materiality")
    )
    dep = ctx.movements.where(R.DEPRECIATION.on(F.col("account"))).groupBy("company_id", "month").agg(F.sum("amount").alias("dep"))
    recent = (
        L.history_months(ctx.coverage, n, include_anchor=True)
        .join(dep, ["company_id", "month"], "left")
        .groupBy("company_id", "anchor")
        .agg(F.count("*").alias("n_recent"), F.sum(F.when(F.coalesce("dep", F.lit(0)) != 0, 1).otherwise(0)).alias("n_dep"))
        .withColumnRenamed("anchor", "month")
    )
    yearly = (
        ctx.coverage.select("company_id", "fy_start", "month").join(dep, ["company_id", "month"], "left").groupBy("company_id", "fy_start").agg(F.sum("dep").alias("year_dep"))
    )
    used = (
        ctx.movements.where(R.DEPRECIABLE.on(F.col("account"))).groupBy("company_id").agg(F.array_sort(F.collect_set("account")).alias("accounts"))
    )
    j = (
        _reviewed(ctx, gross)
        .join(ctx.coverage.select("company_id", "month", "fy_start", "fy_end"), ["company_id", "month"])
        .join(ctx.maturity.select("company_id", "month", "monthly_depreciation"), ["company_id", "month"])
        .join(recent, ["company_id", "month"], "left")
        .join(yearly, ["company_id", "fy_start"], "left")
        .join(used, "company_id", "left")
    )
    monthly = F.coalesce("monthly_depreciation", F.lit(False))
    stopped = monthly & (F.col("n_recent") >= n) & (F.col("n_dep") == 0)
    never = ~monthly & (F.col("month") == F.trunc("fy_end", "MM")) & (F.coalesce("year_dep", F.lit(0)) == 0)
    return finding(
        j.where(stopped | never),
        "ASSETS_WITHOUT_DEPRECIATION",
        review=F.col("month"),
        key=[F.col("fy_start")],
        accounts=F.coalesce("accounts", F.array().cast("array<int>")),
        amount=F.col("gross"),
        variant=F.when(stopped, "monthly").otherwise("yearly"),
    )


@control("VACATION_LIABILITY_STATIC")
def vacation_static(ctx: Context) -> DataFrame:
    n = ctx.param("VACATION_LIABILITY_STATIC", "months")
    a = F.col("account")
    flow = ctx.movements.groupBy("company_id", "month").agg(
        F.sum(F.when(R.SALARY_BASE.on(a), F.col("amount")).otherwise(0)).alias("sal"),
        F.sum(F.when(R.VACATION.on(a), F.col("amount")).otherwise(0)).alias("vac"),
    )
    recent = (
        L.history_months(ctx.coverage, n, include_anchor=True)
        .join(flow, ["company_id", "month"], "left")
        .groupBy("company_id", F.col("anchor").alias("month"))
        .agg(
            F.count("*").alias("n_months"),
            F.min(F.coalesce("sal", F.lit(0))).alias("least_sal"),
            F.max(F.abs(F.coalesce("vac", F.lit(0)))).alias("most_vac"),
        )
    )
    j = recent.join(ctx.maturity.select("company_id", "month", "monthly_vacation_accrual"), ["company_id", "month"])
    return finding(
        j.where((F.col("n_months") >= n) & (F.col("least_sal") > 0) & (F.col("most_vac") == 0) & F.col("monthly_vacation_accrual")),
        "VACATION_LIABILITY_STATIC",
        review=F.col("month"),
        key=[F.date_format("month", _YM)],
        accounts=F.array(F.lit(2920)),
    )


@control("TAX_ALLOCATION_RESERVE_DUE")
def reserve_due(ctx: Context) -> DataFrame:
    j = (
        _reviewed(ctx, ctx.balances.where("account BETWEEN 2110 AND 2149 AND balance < 0"))
        .join(ctx.accounts.select("company_id", "account", allocation_year(F.col("name")).alias("alloc")), ["company_id", "account"])
        .where("alloc IS NOT NULL")
        .join(ctx.coverage.select("company_id", "month", F.year("fy_end").alias("fy_year")), ["company_id", "month"])
        .withColumn("due", F.col("alloc") + rate_on("tax_allocation_reserve_years", F.last_day("month")).cast("int"))
        .where("fy_year >= due")
    )
    return finding(
        j,
        "TAX_ALLOCATION_RESERVE_DUE",
        review=F.col("month"),
        key=[F.col("account"), F.col("alloc")],
        severity=F.when(F.col("fy_year") > F.col("due"), "HIGH").otherwise("MEDIUM"),
        accounts=F.array("account"),
        amount=-F.col("balance"),
    )


@control("NEGATIVE_BANK")
def negative_bank(ctx: Context) -> DataFrame:
    no_credit = ctx.companies.where("NOT has_overdraft").select("company_id")
    hits = _reviewed(ctx, ctx.balances.where(R.BANK.on(F.col("account")) & (F.col("balance") < 0))).join(no_credit, "company_id", "left_semi")
    return finding(
        hits,
        "NEGATIVE_BANK",
        review=F.col("month"),
        key=[F.col("account"), F.date_format("month", _YM)],
        accounts=F.array("account"),
        amount=F.col("balance"),
    )


@control("RELATED_PARTY_RECEIVABLE")
def related_party(ctx: Context) -> DataFrame:
    """Receivables on owners and related parties, with the last ten debit vouchers up to the month.

    Per month only the last ten vouchers can matter, so each month keeps ten (a limit that is
    applied before the shuffle) and a window over the few months joins them up.
    """
    least = ctx.param("RELATED_PARTY_RECEIVABLE", "min_amount")
    pattern = r"(delägare|närstående|aktieägare|styrelse|\bvd\b|ägare)"
    by_name = ctx.accounts.where(
        (F.col("account").between(1300, 1399) | F.col("account").between(1600, 1699)) & F.lower("name").rlike(pattern)
    ).select("company_id", "account")
    fixed = ctx.companies.select("company_id", F.explode(F.array(F.lit(1685), F.lit(1360), F.lit(1369))).alias("account"))
    chosen = by_name.union(fixed).distinct()
    hits = _reviewed(ctx, ctx.balances.where(F.col("balance") >= least))
    claims = hits.join(chosen, ["company_id", "account"], "left_semi")
    debits = (
        ctx.facts.select("company_id", "month", "voucher_date", "voucher", F.explode("eff").alias("r"))
        .where("r.amount > 0")
        .select("company_id", "month", "voucher_date", "voucher", F.col("r.account").alias("account"))
        .where("account BETWEEN 1300 AND 1699")
        .join(chosen, ["company_id", "account"], "left_semi")
        .groupBy("company_id", "account", "month", "voucher_date", "voucher")
        .agg(F.lit(1).alias("one"))
    )
    w = Window.partitionBy("company_id", "account", "month").orderBy(F.desc("voucher_date"), F.desc("voucher"))
    ten = (
        debits.withColumn("rk", F.row_number().over(w))
        .where("rk <= 10")
        .groupBy("company_id", "account", "month")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "voucher")), asc=False), lambda s: s["voucher"]).alias("late"))
    )
    up_to = Window.partitionBy("company_id", "account").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    listed = (
        claims.join(ten, ["company_id", "account", "month"], "full_outer")
        .withColumn("chain", F.flatten(F.collect_list(F.coalesce("late", F.array().cast("array<string>"))).over(up_to)))
        .where("balance IS NOT NULL")
        .withColumn("vouchers", F.expr("slice(chain, greatest(size(chain) - 9, 1), 10)"))
    )
    first = finding(
        listed,
        "RELATED_PARTY_RECEIVABLE",
        review=F.col("month"),
        key=[F.col("account")],
        vouchers=F.col("vouchers"),
        accounts=F.array("account"),
        amount=F.col("balance"),
        variant=F.lit("receivable"),
    )
    debt = finding(
        hits.where("account BETWEEN 2890 AND 2899"),
        "RELATED_PARTY_RECEIVABLE",
        review=F.col("month"),
        key=[F.col("account"), F.lit("debit")],
        accounts=F.array("account"),
        amount=F.col("balance"),
        variant=F.lit("debit"),
    )
    return first.unionByName(debt)


@control("EQUITY_BELOW_HALF_SHARE_CAPITAL")
def equity_below_half(ctx: Context) -> DataFrame:
    capital = ctx.balances.where("account = 2081 AND balance < 0").select("company_id", "month", (-F.col("balance")).alias("capital"))
    j = (
        _reviewed(ctx, capital)
        .join(ctx.balance_wide.select("company_id", "month", "fy_start", "total_equity", "untaxed_reserves"), ["company_id", "month"])
        .withColumn("tax", rate_per_10000("corporate_tax", F.last_day("month")))
        .withColumn("adjusted", F.expr("CAST(total_equity AS DECIMAL(38,0)) * 10000 + CAST(untaxed_reserves AS DECIMAL(38,0)) * (10000 - tax)"))
        .where("adjusted < CAST(capital AS DECIMAL(38,0)) * 5000")
    )
    return finding(
        j,
        "EQUITY_BELOW_HALF_SHARE_CAPITAL",
        review=F.col("month"),
        key=[F.col("fy_start")],
        accounts=F.array(F.lit(2081)),
        amount=F.expr("CAST(adjusted div 10000 AS BIGINT)"),
    )
