"""Ledger core: effective rows, monthly movements, coverage, openings and balances.

The large table is read once, exploded and pre-aggregated to (company, month, account); all later
steps work on that table, whose size depends on the number of companies and months only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.ranges import Accounts, statement_line

COVERED = ("vouchers", "psaldo")


def effective(rows: Column | str = "rows") -> Column:
    """Rows that count: everything but rows removed afterwards."""
    return F.filter(F.col(rows) if isinstance(rows, str) else rows, lambda r: r["status"] != "removed")


def postings(vouchers: DataFrame) -> DataFrame:
    """One record per effective ledger row with its voucher's columns."""
    exploded = vouchers.select(
        *[c for c in vouchers.columns if c not in ("rows", "text")],
        F.col("text").alias("voucher_text"),
        F.posexplode("rows").alias("row_no", "r"),
    )
    out = exploded.select(*[c for c in exploded.columns if c != "r"], "r.*")
    return out.where(F.col("status") != "removed").withColumnRenamed("text", "row_text")


def monthly_movements(vouchers: DataFrame) -> DataFrame:
    """Net movement per company, month (of the voucher date) and account; zero nets dropped."""
    rows = vouchers.select("company_id", F.trunc("voucher_date", "MM").alias("month"), F.explode("rows").alias("r"))
    return (
        rows.where(F.col("r.status") != "removed")
        .groupBy("company_id", "month", F.col("r.account").alias("account"))
        .agg(F.sum("r.amount").alias("amount"))
        .where(F.col("amount") != 0)
    )


def voucher_rollup(vouchers: DataFrame) -> DataFrame:
    """Per voucher: balance, debit total, accounts, row count and the largest debit/credit pair.

    All of it is computed inside the voucher record; the first row wins ties in the pair.
    """
    rows = effective()
    best_debit = F.aggregate(
        rows,
        F.expr("CAST(NULL AS struct<account:int,amount:bigint>)"),
        lambda acc, r: F.when(
            acc.isNull() | (r["amount"] > acc["amount"]), F.struct(r["account"].alias("account"), r["amount"].alias("amount"))
        ).otherwise(acc),
    )
    best_credit = F.aggregate(
        rows,
        F.expr("CAST(NULL AS struct<account:int,amount:bigint>)"),
        lambda acc, r: F.when(
            acc.isNull() | (r["amount"] < acc["amount"]), F.struct(r["account"].alias("account"), r["amount"].alias("amount"))
        ).otherwise(acc),
    )
    out = (
        vouchers.withColumn("eff", rows)
        .withColumn("balance", sum_rows(F.col("eff")))
        .withColumn("debit_total", sum_rows(F.col("eff"), lambda r: r["amount"] > 0))
        .withColumn("accounts", F.array_sort(F.array_distinct(F.transform("eff", lambda r: r["account"]))))
        .withColumn("row_count", F.size("eff"))
        .withColumn("hi", best_debit)
        .withColumn("lo", best_credit)
    )
    paired = (F.col("hi.amount") > 0) & (F.col("lo.amount") < 0)
    return out.select(
        *[c for c in vouchers.columns if c != "rows"],
        "balance",
        "debit_total",
        "accounts",
        "row_count",
        F.when(paired, F.col("hi.account")).alias("debit_account"),
        F.when(paired, F.col("lo.account")).alias("credit_account"),
    )


def sum_rows(rows: Column, where=None) -> Column:
    """Sum of the amounts of an array of rows, optionally of the rows a predicate selects."""
    picked = rows if where is None else F.filter(rows, where)
    return F.aggregate(picked, F.lit(0).cast("bigint"), lambda acc, r: acc + r["amount"])


def signature(rows: Column) -> Column:
    """Net amount per account of a voucher, sorted, zeros dropped — as ``array<struct>``."""
    accs = F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["account"])))
    nets = F.transform(
        accs,
        lambda a: F.struct(a.alias("account"), sum_rows(F.filter(rows, lambda r: r["account"] == a)).alias("amount")),
    )
    return F.filter(nets, lambda s: s["amount"] != 0)


# ------------------------------------------------------------------------------------- coverage
def month_coverage(fiscal_years: DataFrame, period_amounts: DataFrame | None = None, year_balances: DataFrame | None = None) -> DataFrame:
    """Calendar of fiscal months and where each month's figures come from.

    ``vouchers`` / ``psaldo`` count as data, ``annual`` means only the whole year is known and
    ``none`` means missing, which is never the same as zero.
    """
    months = fiscal_years.select(
        "*", F.explode(F.expr("sequence(trunc(fy_start, 'MM'), trunc(fy_end, 'MM'), interval 1 month)")).alias("month")
    )
    by_voucher = F.when(
        F.col("covered_months").isNull() | F.array_contains("covered_months", F.col("month")), "vouchers"
    ).otherwise("none")
    if period_amounts is None:
        source = F.when(F.col("has_vouchers"), by_voucher).otherwise("none")
    else:
        psaldo = (
            period_amounts.where("kind = 'PSALDO'")
            .select("company_id", "fy_start", "month", F.lit(True).alias("ps"))
            .distinct()
        )
        months = months.join(psaldo, ["company_id", "fy_start", "month"], "left")
        source = F.when(F.col("has_vouchers"), by_voucher).when(F.col("ps"), "psaldo").otherwise("none")
    out = months.withColumn("source", source)
    if year_balances is not None:
        annual = (
            year_balances.where("kind IN ('RES', 'UB')")
            .select("company_id", "fy_start", F.lit(True).alias("an"))
            .distinct()
        )
        out = out.join(annual, ["company_id", "fy_start"], "left").withColumn(
            "source",
            F.when(~F.col("has_vouchers") & (F.col("source") == "none") & F.col("an"), "annual").otherwise(F.col("source")),
        )
    return out.select("company_id", "fy_start", "fy_end", "month", "source", F.col("source").isin(*COVERED).alias("covered"))


def psaldo_movements(period_amounts: DataFrame, year_balances: DataFrame) -> DataFrame:
    """Movements from period balances: result accounts as given, balance accounts as differences."""
    ib = year_balances.where("kind = 'IB'").select("company_id", "fy_start", "account", F.col("amount").alias("ib"))
    w = Window.partitionBy("company_id", "fy_start", "account").orderBy("month")
    ps = period_amounts.where("kind = 'PSALDO'").join(ib, ["company_id", "fy_start", "account"], "left")
    before = F.coalesce(F.lag("amount").over(w), F.col("ib"), F.lit(0))
    return ps.select(
        "company_id",
        "month",
        "account",
        F.when(F.col("account") >= 3000, F.col("amount")).otherwise(F.col("amount") - before).alias("amount"),
    )


def annual_movements(year_balances: DataFrame, fiscal_years: DataFrame) -> DataFrame:
    """Whole-year movement of years known only as year balances: RES, and UB − IB where IB exists."""
    summary = fiscal_years.where(~F.col("has_vouchers")).select("company_id", "fy_start")
    closed = year_balances.where("kind IN ('RES', 'UB')").select("company_id", "fy_start").distinct()  # an opening alone is no year
    yb = year_balances.join(summary.join(closed, ["company_id", "fy_start"], "left_semi"), ["company_id", "fy_start"], "left_semi")
    has_ib = yb.where("kind = 'IB'").select("company_id", "fy_start").distinct()
    balance = yb.where("account < 3000 AND kind IN ('IB', 'UB')").join(has_ib, ["company_id", "fy_start"], "left_semi")
    signed = balance.withColumn("amount", F.when(F.col("kind") == "UB", F.col("amount")).otherwise(-F.col("amount")))
    rows = signed.unionByName(yb.where("account >= 3000 AND kind = 'RES'"))
    return (
        rows.groupBy("company_id", "fy_start", "account").agg(F.sum("amount").alias("amount")).where("amount <> 0")
    )


def source_movements(voucher_movements: DataFrame, period_amounts: DataFrame, year_balances: DataFrame, coverage: DataFrame) -> DataFrame:
    """Monthly movements from whatever counts for each month: vouchers where the year has them, else period balances."""
    source = lambda name: coverage.where(F.col("source") == name).select("company_id", "month")
    booked = voucher_movements.join(coverage.where("source <> 'psaldo'").select("company_id", "month"), ["company_id", "month"], "left_semi")
    told = psaldo_movements(period_amounts, year_balances).join(source("psaldo"), ["company_id", "month"], "left_semi")
    both = booked.select("company_id", "month", "account", "amount").unionByName(told)
    return both.groupBy("company_id", "month", "account").agg(F.sum("amount").alias("amount")).where("amount <> 0")


def period_movements(periods: DataFrame, movements: DataFrame, annual: DataFrame, coverage: DataFrame) -> DataFrame:
    """Movement per account and period: its months summed, or the year's totals.

    A period that is a whole fiscal year known only by its balances takes those; months that are there take
    precedence. ``periods``: company_id, period, start, end. ``annual``: see ``annual_movements``.
    """
    months = periods.select("company_id", "period", F.explode(F.expr("sequence(trunc(start, 'MM'), trunc(end, 'MM'), interval 1 month)")).alias("month"))
    known = months.join(coverage.select("company_id", "month", "covered"), ["company_id", "month"], "left")
    whole = known.groupBy("company_id", "period").agg(F.min(F.coalesce("covered", F.lit(False))).alias("whole"))
    years = coverage.select("company_id", F.col("fy_start").alias("start"), F.col("fy_end").alias("end")).distinct()
    fits = periods.select("company_id", "period", "start", "end").join(years, ["company_id", "start", "end"]).select("company_id", "period", F.col("start").alias("fy_start"))
    summary = annual.select("company_id", "fy_start").distinct()
    yearly = fits.join(summary, ["company_id", "fy_start"], "left_semi").join(whole.where("NOT whole"), ["company_id", "period"]).select("company_id", "period", "fy_start")
    monthly = months.join(yearly.select("company_id", "period"), ["company_id", "period"], "left_anti").join(movements, ["company_id", "month"])
    summed = monthly.groupBy("company_id", "period", "account").agg(F.sum("amount").alias("amount")).where("amount <> 0")
    return summed.unionByName(yearly.join(annual, ["company_id", "fy_start"]).select("company_id", "period", "account", "amount"))


def closings(year_balances: DataFrame, coverage: DataFrame) -> DataFrame:
    """(company_id, fy_start, month, account, amount): closing balances, at their last month, of years known only by balances."""
    ends = coverage.where("source = 'annual'").groupBy("company_id", "fy_start").agg(F.trunc(F.max("fy_end"), "MM").alias("month"))
    return year_balances.where("kind = 'UB' AND account < 3000").join(ends, ["company_id", "fy_start"]).select("company_id", "fy_start", "month", "account", "amount")


def result_to_date(movements: DataFrame, coverage: DataFrame, year_balances: DataFrame | None = None, closing_entries: bool = True) -> DataFrame:
    """Result per account from the start of the fiscal year to every month end (positive: profit).

    A cumulative sum that starts anew with every fiscal year. Accounts go to 8999, or to 8989 without the closing
    entries. At the end of a year known only by balances its result balances count; the closing balances decide
    what is not closed yet, so a gap to them is put on 8999.
    """
    upper = 8999 if closing_entries else 8989
    months = coverage.select("company_id", "fy_start", "month")
    moved = movements.where(F.col("account").between(3000, upper)).join(months, ["company_id", "month"])
    grid = moved.select("company_id", "fy_start", "account").distinct().join(months, ["company_id", "fy_start"])
    upto = Window.partitionBy("company_id", "fy_start", "account").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(moved.select("company_id", "month", "account", "amount"), ["company_id", "month", "account"], "left")
    out = filled.withColumn("amount", -F.sum(F.coalesce("amount", F.lit(0))).over(upto)).where("amount <> 0").select("company_id", "fy_start", "month", "account", "amount")
    if year_balances is None:
        return out
    closed = closings(year_balances, coverage)
    ends = closed.groupBy("company_id", "fy_start", "month").agg(F.sum("amount").alias("unclosed"))
    told = year_balances.where((F.col("kind") == "RES") & F.col("account").between(3000, upper)).join(ends, ["company_id", "fy_start"])
    told = told.select("company_id", "fy_start", "month", "account", (-F.col("amount")).alias("amount"))
    if closing_entries:
        summed = told.groupBy("company_id", "fy_start").agg(F.sum("amount").alias("told"))
        gap = ends.join(summed, ["company_id", "fy_start"], "left").select("company_id", "fy_start", "month", F.lit(8999).alias("account"), (F.col("unclosed") - F.coalesce("told", F.lit(0))).alias("amount"))
        told = told.unionByName(gap).groupBy("company_id", "fy_start", "month", "account").agg(F.sum("amount").alias("amount"))
    return out.join(ends.select("company_id", "month"), ["company_id", "month"], "left_anti").unionByName(told.where("amount <> 0"))


def latest_data(coverage: DataFrame, movements: DataFrame) -> DataFrame:
    """Latest month with vouchers and the data horizon (last day of it, else of a PSALDO month)."""
    booked = movements.select("company_id", "month", F.lit(True).alias("booked")).distinct()
    j = coverage.join(booked, ["company_id", "month"], "left")
    agg = j.groupBy("company_id").agg(
        F.max(F.when((F.col("source") == "vouchers") & F.col("booked"), F.col("month"))).alias("latest_month"),
        F.max(F.when(F.col("source") == "psaldo", F.col("month"))).alias("ps"),
    )
    return agg.select("company_id", "latest_month", F.last_day(F.coalesce("latest_month", "ps")).alias("horizon"))


def history_months(coverage: DataFrame, n: int, include_anchor: bool = False) -> DataFrame:
    """For every covered month, the last ``n`` months *with data* before it (newest rank 1).

    Ranks over covered months, not calendar offsets; a company has few months, so the self-join
    stays on (company) with a rank band.
    """
    w = Window.partitionBy("company_id").orderBy("month")
    ranked = coverage.where("covered").select("company_id", "month", F.row_number().over(w).alias("rk"))
    anchor = ranked.select("company_id", F.col("month").alias("anchor"), F.col("rk").alias("ark"))
    shift = 0 if include_anchor else 1
    wanted = anchor.select(
        "company_id",
        "anchor",
        F.explode(F.expr(f"sequence(greatest(ark - {n} + 1 - {shift}, 1), ark - {shift})")).alias("rk"),
    ).where("rk >= 1") if include_anchor else anchor.where("ark > 1").select(
        "company_id", "anchor", F.explode(F.expr(f"sequence(greatest(ark - {n}, 1), ark - 1)")).alias("rk")
    )
    return wanted.join(ranked, ["company_id", "rk"]).select("company_id", "anchor", "month")


# ------------------------------------------------------------------------------ openings, balances
def opening_basis(fiscal_years: DataFrame, year_balances: DataFrame) -> DataFrame:
    """How every fiscal year gets its opening balance, and whether it is known.

    ``ib`` own opening balance · ``ub`` previous closing balance · ``derived`` previous year's
    opening plus its vouchers (only if contiguous, complete and itself known) · ``none``. Years
    that derive from each other share a ``segment``, so no year-by-year loop is needed.
    """
    kinds = year_balances.groupBy("company_id", "fy_start").agg(
        F.max(F.expr("kind = 'IB'")).alias("has_ib"), F.max(F.expr("kind = 'UB'")).alias("has_ub")
    )
    w = Window.partitionBy("company_id").orderBy("fy_start")
    complete = F.col("has_vouchers") & F.expr(
        "covered_months IS NULL OR forall(sequence(trunc(fy_start, 'MM'), trunc(fy_end, 'MM'), interval 1 month), "
        "m -> array_contains(covered_months, m))"
    )
    y = (
        fiscal_years.join(kinds, ["company_id", "fy_start"], "left")
        .withColumn("has_ib", F.coalesce("has_ib", F.lit(False)))
        .withColumn("has_ub", F.coalesce("has_ub", F.lit(False)))
        .withColumn("complete", complete)
        .withColumn("prev_start", F.lag("fy_start").over(w))
        .withColumn("contiguous", F.coalesce(F.lag("fy_end").over(w) == F.date_sub("fy_start", 1), F.lit(False)))
        .withColumn("prev_ub", F.coalesce(F.lag("has_ub").over(w), F.lit(False)) & F.col("contiguous"))
        .withColumn("prev_complete", F.coalesce(F.lag("complete").over(w), F.lit(False)) & F.col("contiguous"))
        .withColumn(
            "kind",
            F.when(F.col("has_ib"), "ib").when(F.col("prev_ub"), "ub").when(F.col("prev_complete"), "derived").otherwise("none"),
        )
        .withColumn("segment", F.sum(F.when(F.col("kind") == "derived", 0).otherwise(1)).over(w))
    )
    seg = Window.partitionBy("company_id", "segment").orderBy("fy_start")
    self_known = (F.col("kind") != "none") & (F.col("kind") != "derived") | (F.col("opening_status") != "missing")
    return (
        y.withColumn("anchor_known", F.first(self_known).over(seg))
        .withColumn("opening_known", F.col("anchor_known") | (F.max(F.expr("opening_status <> 'missing'")).over(seg)))
        .withColumn("anchor_start", F.first("fy_start").over(seg))
        .select(
            "company_id", "fy_start", "fy_end", "prev_start", "kind", "segment", "anchor_start", "anchor_known", "opening_known"
        )
    )


def anchor_openings(basis: DataFrame, year_balances: DataFrame) -> DataFrame:
    """Opening rows that come straight from a source: own IB, else the previous year's UB."""
    ib = (
        year_balances.where("kind = 'IB'")
        .join(basis.where("kind = 'ib'").select("company_id", "fy_start"), ["company_id", "fy_start"])
        .select("company_id", "fy_start", "account", "amount")
    )
    ub = (
        year_balances.where("kind = 'UB' AND account < 3000")
        .withColumnRenamed("fy_start", "prev_start")
        .join(basis.where("kind = 'ub'").select("company_id", "fy_start", "prev_start"), ["company_id", "prev_start"])
        .select("company_id", "fy_start", "account", "amount")
    )
    gap = ub.groupBy("company_id", "fy_start").agg((-F.sum("amount")).alias("amount")).select(
        "company_id", "fy_start", F.lit(2099).alias("account"), "amount"
    )
    rows = ib.unionByName(ub.unionByName(gap).groupBy("company_id", "fy_start", "account").agg(F.sum("amount").alias("amount")))
    return rows.where("amount <> 0")


def opening_balances(movements: DataFrame, basis: DataFrame, year_balances: DataFrame) -> DataFrame:
    """Opening balance per company, fiscal year and account.

    Within a segment an opening is the anchor's opening plus all movements since, where the result
    not yet closed lands on 2099: one cumulative window per (company, segment, account).
    """
    seeds = anchor_openings(basis, year_balances).join(
        basis.select("company_id", "fy_start", "segment"), ["company_id", "fy_start"]
    )
    in_year = F.col("month").between(F.trunc("fy_start", "MM"), F.col("fy_end"))
    spans = basis.where("anchor_known").select("company_id", "fy_start", "fy_end", "segment")
    yearly = (
        movements.where("account BETWEEN 1000 AND 8999 OR account < 1000")
        .withColumn("account", F.expr("CASE WHEN account < 3000 THEN account ELSE 2099 END"))
        .join(spans, "company_id")
        .where(in_year)
        .groupBy("company_id", "segment", "fy_start", "account")
        .agg(F.sum("amount").alias("amount"))
    )
    events = yearly.withColumn("seed", F.lit(0).cast("bigint")).unionByName(
        seeds.select("company_id", "segment", "fy_start", "account", F.lit(0).cast("bigint").alias("amount"), F.col("amount").alias("seed"))
    )
    events = events.groupBy("company_id", "segment", "fy_start", "account").agg(
        F.sum("amount").alias("amount"), F.sum("seed").alias("seed")
    )
    grid = (
        events.select("company_id", "segment", "account")
        .distinct()
        .join(basis.select("company_id", "segment", "fy_start"), ["company_id", "segment"])
    )
    w = Window.partitionBy("company_id", "segment", "account").orderBy("fy_start")
    filled = grid.join(events, ["company_id", "segment", "fy_start", "account"], "left").na.fill(0, ["amount", "seed"])
    before = F.coalesce(F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeded = F.sum("seed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        filled.withColumn("opening", before + seeded)
        .where("opening <> 0")
        .select("company_id", "fy_start", "account", F.col("opening").alias("amount"))
    )


def balances(movements: DataFrame, coverage: DataFrame, openings: DataFrame, accounts: Accounts | None = None, closed: DataFrame | None = None) -> DataFrame:
    """Month-end balance per account below 3000 for every fiscal month (zero balances dropped).

    ``closed`` (see ``closings``) has the balances at the end of years known only by their balances.
    """
    keep = F.col("account") < 3000
    if accounts is not None:
        keep = keep & accounts.on(F.col("account"))
    months = coverage.select("company_id", "fy_start", "month")
    moved = movements.where(keep).join(months, ["company_id", "month"]).select(
        "company_id", "fy_start", "account", "month", "amount"
    )
    start = openings.where(keep).select(
        "company_id", "fy_start", "account", F.trunc("fy_start", "MM").alias("month"), "amount"
    )
    changes = moved.unionByName(start).groupBy("company_id", "fy_start", "account", "month").agg(F.sum("amount").alias("amount"))
    grid = changes.select("company_id", "fy_start", "account").distinct().join(months, ["company_id", "fy_start"])
    w = Window.partitionBy("company_id", "fy_start", "account").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        grid.join(changes, ["company_id", "fy_start", "account", "month"], "left")
        .withColumn("balance", F.sum(F.coalesce("amount", F.lit(0))).over(w))
        .where("balance <> 0")
        .select("company_id", "fy_start", "month", "account", "balance")
    )
    if closed is None:
        return out
    told = closed.where(keep & (F.col("amount") != 0)).select("company_id", "fy_start", "month", "account", F.col("amount").alias("balance"))
    return out.join(closed.select("company_id", "month").distinct(), ["company_id", "month"], "left_anti").unionByName(told)


def balance_complete(coverage: DataFrame, basis: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Months whose balances can be trusted: known opening and no missing month since year start, or closing balances."""
    w = Window.partitionBy("company_id", "fy_start").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    out = coverage.join(basis.select("company_id", "fy_start", "opening_known"), ["company_id", "fy_start"]).select(
        "company_id", "month", (F.min("covered").over(w) & F.col("opening_known")).alias("balance_complete")
    )
    if closed is None:
        return out
    ends = closed.select("company_id", "month", F.lit(True).alias("told")).distinct()
    return out.join(ends, ["company_id", "month"], "left").select("company_id", "month", (F.col("balance_complete") | F.coalesce("told", F.lit(False))).alias("balance_complete"))


def balance_at(vouchers: DataFrame, movements: DataFrame, coverage: DataFrame, openings: DataFrame, dates: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Balance per account at the end of arbitrary days (``dates``: company_id, at).

    Whole months come from the aggregated movements; only the last, broken month is read from the
    vouchers, joined on (company, month). A month of period balances counts whole, and the last day of a year
    known only by its balances has those (``closed``).
    """
    if closed is not None:
        ends = closed.withColumn("at", F.last_day("month"))
        direct = dates.select("company_id", "at").distinct().join(ends, ["company_id", "at"])
        told = direct.where("amount <> 0").select("company_id", "at", "account", F.col("amount").alias("balance"))
        rest = dates.join(ends.select("company_id", "at").distinct(), ["company_id", "at"], "left_anti")
        return balance_at(vouchers, movements, coverage, openings, rest).unionByName(told)
    at = dates.select("company_id", "at", F.trunc("at", "MM").alias("month")).distinct()
    span = at.join(coverage.select("company_id", "month", "fy_start", "source"), ["company_id", "month"])
    opening = openings.join(span, ["company_id", "fy_start"]).select("company_id", "at", "account", "amount")
    full = span.select(
        "company_id",
        "at",
        F.explode(F.expr("CASE WHEN source = 'psaldo' THEN sequence(trunc(fy_start, 'MM'), month, interval 1 month) WHEN month > fy_start THEN sequence(trunc(fy_start, 'MM'), add_months(month, -1), interval 1 month) END")).alias("month"),
    )
    whole = movements.where("account < 3000").join(full, ["company_id", "month"]).select("company_id", "at", "account", "amount")
    rows = vouchers.select("company_id", "fy_start", "voucher_date", F.trunc("voucher_date", "MM").alias("month"), F.explode("rows").alias("r"))
    part = (
        rows.where("r.status <> 'removed' AND r.account < 3000")
        .join(span.where("source <> 'psaldo'").select("company_id", "fy_start", "month", "at"), ["company_id", "fy_start", "month"])
        .where("voucher_date <= at")
        .select("company_id", "at", F.col("r.account").alias("account"), F.col("r.amount").alias("amount"))
    )
    return (
        opening.unionByName(whole)
        .unionByName(part)
        .groupBy("company_id", "at", "account")
        .agg(F.sum("amount").alias("balance"))
        .where("balance <> 0")
    )


def unmapped_accounts(vouchers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Used accounts without a name, with up to three example texts and a suggested line.

    The three texts are the smallest distinct ones, found by aggregation on (company, account,
    text) first so a busy account never gathers in one task.
    """
    named = accounts.where("name IS NOT NULL AND name <> concat('Konto ', account)").select("company_id", "account")
    rows = vouchers.select("company_id", "text", F.explode("rows").alias("r")).where("r.status <> 'removed'")
    texts = (
        rows.select("company_id", F.col("r.account").alias("account"), "text")
        .join(named, ["company_id", "account"], "left_anti")
        .groupBy("company_id", "account", "text")
        .agg(F.count("*").alias("n"))
    )
    salted = texts.withColumn("salt", F.pmod(F.hash("text"), F.lit(64)))
    top = lambda keys: Window.partitionBy(*keys).orderBy("text")
    part = salted.withColumn("rk", F.row_number().over(top(["company_id", "account", "salt"])))
    counts = texts.groupBy("company_id", "account").agg(F.sum("n").alias("rows"))
    best = (
        part.where("rk <= 3")
        .withColumn("rk", F.row_number().over(top(["company_id", "account"])))
        .where("rk <= 3")
        .groupBy("company_id", "account")
        .agg(F.array_join(F.array_sort(F.collect_list("text")), " | ").alias("examples"))
    )
    return counts.join(best, ["company_id", "account"]).select(
        "company_id", "account", "rows", "examples", statement_line(F.col("account")).alias("suggested_line")
    )


#: Months of the longest fiscal year.
LONGEST_YEAR = 18


def transactions(
    vouchers: DataFrame,
    *,
    account: int | None = None,
    start: str | None = None,
    end: str | None = None,
    text: str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """Page of ledger rows, newest first, filtered by account, date range and text."""
    p = postings(vouchers)
    if account is not None:
        p = p.where(F.col("account") == account)
    # A date lies in a fiscal year that began by then, at most LONGEST_YEAR months before: tables laid out
    # by fiscal year skip the others.
    if start is not None:
        first = F.lit(start).cast("date")
        p = p.where((F.col("voucher_date") >= first) & (F.col("fy_start") > F.add_months(first, -LONGEST_YEAR)))
    if end is not None:
        last = F.lit(end).cast("date")
        p = p.where((F.col("voucher_date") <= last) & (F.col("fy_start") <= last))
    if text:
        needle = F.lit(text.lower())
        p = p.where(F.contains(F.lower("voucher_text"), needle) | F.contains(F.lower("row_text"), needle))
    order = [F.desc("voucher_date"), F.asc("company_id"), F.asc("series"), F.asc("number"), F.asc("row_no")]
    return p.orderBy(*order).offset(offset).limit(limit)


def find_voucher(vouchers: DataFrame, series: str, number: str, on: str | None = None) -> DataFrame:
    """A voucher by key per company, preferring the fiscal year of ``on``, else the newest."""
    hit = vouchers.where((F.col("series") == series) & (F.col("number") == number))
    inside = (
        F.lit(False)
        if on is None
        else F.lit(on).cast("date").between(F.col("fy_start"), F.date_sub(F.add_months("fy_start", 12), 1))
    )
    w = Window.partitionBy("company_id").orderBy(F.desc(inside), F.desc("fy_start"), F.desc("voucher_date"))
    return hit.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def registered_late(vouchers: DataFrame, since: str, limit: int = 30) -> DataFrame:
    """Vouchers registered on or after a day but dated before it."""
    day = F.lit(since).cast("date")
    return (
        vouchers.where((F.col("reg_date") >= day) & (F.col("voucher_date") < day) & (F.col("fy_start") < day))
        .select("company_id", "series", "number", "voucher_date", "reg_date")
        .orderBy("reg_date", "voucher_date", "company_id", "series", "number")
        .limit(limit)
    )
