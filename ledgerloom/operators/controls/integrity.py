"""Integrity and timing controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.controls.base import Context, control, finding
from ledgerloom.operators.voucher_facts import business_days

#: Voucher numbers per chunk when neighbours are looked up; a chunk is one window group.
CHUNK = 100_000


@control("UNBALANCED_VOUCHER")
def unbalanced(ctx: Context) -> DataFrame:
    tol = ctx.param("UNBALANCED_VOUCHER", "tolerance")
    hits = ctx.facts.where(F.abs("balance") > tol)
    return finding(
        hits,
        "UNBALANCED_VOUCHER",
        review=F.col("month"),
        key=[F.year("voucher_date"), F.col("voucher")],
        vouchers=F.array("voucher"),
        accounts=F.col("accounts"),
        amount=F.col("balance"),
    )


@control("IB_NE_PREV_UB")
def opening_differs(ctx: Context) -> DataFrame:
    """Own opening balances against the previous year's closing; 2090–2099 as one group."""
    tol = ctx.param("IB_NE_PREV_UB", "tolerance")
    w = Window.partitionBy("company_id").orderBy("fy_start")
    years = ctx.fiscal_years.select(
        "company_id",
        "fy_start",
        F.lag("fy_start").over(w).alias("prev_start"),
        F.lag("fy_end").over(w).alias("prev_end"),
        F.lag("has_vouchers").over(w).alias("prev_vouchers"),
    ).where("prev_start IS NOT NULL")
    ib = ctx.year_balances.where("kind = 'IB' AND account < 3000").select("company_id", "fy_start", "account", F.col("amount").alias("ib"))
    with_ib = years.join(ib.select("company_id", "fy_start").distinct(), ["company_id", "fy_start"])
    booked = with_ib.where("prev_vouchers").withColumn("month", F.trunc("prev_end", "MM"))
    ub = booked.select("company_id", F.col("fy_start").alias("this_fy"), "month").join(
        ctx.balances.select("company_id", "month", "account", "balance"), ["company_id", "month"]
    ).select("company_id", F.col("this_fy").alias("fy_start"), "account", F.col("balance").alias("ub"))
    closing = (
        with_ib.where("NOT prev_vouchers")
        .join(
            ctx.year_balances.where("kind = 'UB' AND account < 3000").select("company_id", F.col("fy_start").alias("prev_start"), "account", F.col("amount").alias("ub")),
            ["company_id", "prev_start"],
        )
        .select("company_id", "fy_start", "account", "ub")
    )
    result = (
        booked.select("company_id", F.col("fy_start").alias("this_fy"), F.col("prev_start").alias("fy_start"))
        .join(ctx.coverage.select("company_id", "fy_start", "month"), ["company_id", "fy_start"])
        .join(ctx.movements.where("account BETWEEN 3000 AND 8999"), ["company_id", "month"])
        .groupBy("company_id", F.col("this_fy").alias("fy_start"))
        .agg(F.sum("amount").alias("ub"))
        .select("company_id", "fy_start", F.lit(2099).alias("account"), "ub")
    )
    zero = F.lit(0).cast("bigint")
    sides = (
        ib.join(with_ib.select("company_id", "fy_start"), ["company_id", "fy_start"])
        .withColumn("ub", zero)
        .unionByName(ub.unionByName(closing).unionByName(result).withColumn("ib", zero))
    )
    equity = F.col("account").between(2090, 2099)
    grouped = (
        sides.withColumn("label", F.when(equity, "2090-2099").otherwise(F.col("account").cast("string")))
        .groupBy("company_id", "fy_start", "label")
        .agg(F.sum("ib").alias("ib"), F.sum("ub").alias("ub"), F.array_sort(F.collect_set("account")).alias("accounts"))
        .withColumn("diff", F.col("ib") - F.col("ub"))
        .where(F.abs("diff") > tol)
    )
    return finding(
        grouped,
        "IB_NE_PREV_UB",
        review=F.col("fy_start"),
        key=[F.col("fy_start"), F.col("label")],
        accounts=F.col("accounts"),
        amount=F.col("diff"),
    )


def numbered(facts: DataFrame) -> DataFrame:
    """Vouchers with a numeric number, one row per distinct number of a series and year."""
    num = facts.where(F.col("number").rlike("^[0-9]+$")).withColumn("no", F.expr("try_cast(number AS bigint)")).where("no IS NOT NULL")
    return num.groupBy("company_id", "fy_start", "series", "no").agg(
        F.count("*").alias("n"), F.min(F.struct("voucher_date", "voucher")).alias("first"), F.max(F.struct("voucher_date", "voucher")).alias("last")
    )


@control("VOUCHER_NUMBER_GAP")
def number_gap(ctx: Context) -> DataFrame:
    """Duplicates and gaps per series and fiscal year; each gap is reported as one range.

    A series may hold a large part of all vouchers, so it is not one window group: numbers are cut
    into chunks, neighbours are found inside a chunk, and the chunk borders are compared in a
    second, tiny window.
    """
    keys = ["company_id", "fy_start", "series"]
    nums = numbered(ctx.facts).withColumn("chunk", F.expr(f"no div {CHUNK}"))
    dup = finding(
        nums.where("n > 1"),
        "VOUCHER_NUMBER_GAP",
        review=F.col("last.voucher_date"),
        key=[F.col("fy_start"), F.col("series"), F.col("no"), F.lit("dup")],
        vouchers=F.array(F.concat("series", F.col("no").cast("string"))),
        variant=F.lit("duplicate"),
    )
    inside = Window.partitionBy(*keys, "chunk").orderBy("no")
    near = nums.select(*keys, "no", "chunk", F.col("last.voucher_date").alias("next_date"), F.lag("no").over(inside).alias("prev"))
    border = nums.groupBy(*keys, "chunk").agg(F.max("no").alias("hi"))
    over = Window.partitionBy(*keys).orderBy("chunk")
    border = border.select(*keys, "chunk", F.lag("hi").over(over).alias("border"))
    first = near.where("prev IS NULL").join(border, [*keys, "chunk"]).select(*keys, "no", "next_date", F.col("border").alias("prev"))
    gaps = (
        near.where("prev IS NOT NULL")
        .select(*keys, "no", "next_date", "prev")
        .unionByName(first)
        .where("no - prev > 1")
        .withColumn("lo", F.col("prev") + 1)
        .withColumn("hi", F.col("no") - 1)
    )
    name = lambda c: F.concat("series", F.col(c).cast("string"))
    gap = finding(
        gaps,
        "VOUCHER_NUMBER_GAP",
        review=F.col("next_date"),
        key=[F.col("fy_start"), F.col("series"), F.col("lo"), F.col("hi")],
        vouchers=F.when(F.col("lo") == F.col("hi"), F.array(name("lo"))).otherwise(F.array(name("lo"), name("hi"))),
        variant=F.lit("gap"),
    )
    return dup.unionByName(gap)


@control("LATE_BOOKING")
def late_booking(ctx: Context) -> DataFrame:
    """Reviewed in the month of registration, when the delay becomes visible."""
    lag = F.when(F.col("has_cash"), business_days(F.col("voucher_date"), F.col("reg_date"))).otherwise(F.datediff("reg_date", "voucher_date"))
    limit = F.when(F.col("has_cash"), ctx.param("LATE_BOOKING", "cash_max_days")).otherwise(ctx.param("LATE_BOOKING", "other_max_days"))
    hits = ctx.facts.where("reg_date IS NOT NULL").withColumn("lag", lag).where(F.col("lag") > limit)
    return finding(
        hits,
        "LATE_BOOKING",
        review=F.col("reg_date"),
        key=[F.col("voucher"), F.col("voucher_date")],
        severity=F.when(F.col("has_cash"), "MEDIUM").otherwise("LOW"),
        vouchers=F.array("voucher"),
        variant=F.concat_ws(":", F.when(F.col("has_cash"), "cash").otherwise("other"), F.col("lag").cast("string")),
    )


@control("ACCOUNT_NOT_IN_CHART")
def not_in_chart(ctx: Context) -> DataFrame:
    """Accounts without a name in the chart, or outside 1000–8999; ten vouchers as examples."""
    named = ctx.accounts.where("name IS NOT NULL AND name <> concat('Konto ', account)").select("company_id", "account", F.lit(True).alias("known"))
    used = (
        ctx.facts.select("company_id", "month", "voucher", F.explode("accounts").alias("account"))
        .join(named, ["company_id", "account"], "left")
        .where("known IS NULL OR NOT account BETWEEN 1000 AND 8999")
        .groupBy("company_id", "month", "account", "voucher")
        .agg(F.first("known").alias("known"))
    )
    w = Window.partitionBy("company_id", "month", "account").orderBy("voucher")
    hits = (
        used.withColumn("rk", F.row_number().over(w))
        .where("rk <= 10")
        .groupBy("company_id", "month", "account")
        .agg(F.array_sort(F.collect_list("voucher")).alias("vouchers"), F.max("known").alias("known"))
    )
    return finding(
        hits,
        "ACCOUNT_NOT_IN_CHART",
        review=F.col("month"),
        key=[F.col("account")],
        vouchers=F.col("vouchers"),
        accounts=F.array("account"),
        variant=F.when(F.col("known").isNull(), "missing").otherwise("outside"),
    )


@control("CHANGED_AFTER_APPROVAL")
def changed_after_approval(ctx: Context) -> DataFrame:
    """Approved months whose vouchers changed since approval (``ctx.changed``, see ``versions.changed_months``).

    The key holds a checksum of all changes: a later change is a new finding. ``variant`` is their number;
    the vouchers are the rows of ``versions.changes``.
    """
    changed = ctx.changed
    if changed is None:
        changed = ctx.coverage.where("false").select("company_id", "month", F.lit(0).cast("bigint").alias("n"), F.lit("").alias("change_key"))
    month = F.date_format("month", "yyyy-MM")
    return finding(changed, "CHANGED_AFTER_APPROVAL", review=F.col("month"), key=[month, F.col("change_key")], variant=F.col("n").cast("string"))
