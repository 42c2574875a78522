"""Money laundering signals; their visibility is restricted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import ranges as R
from ledgerloom.operators.controls.base import Context, control, finding

#: Amounts are matched within classes of this ratio; wider than any tolerance up to 10 %.
_CLASS = 1.12


def _rows(ctx: Context) -> DataFrame:
    return ctx.facts.select("company_id", "month", "voucher", F.explode("eff").alias("r")).select(
        "company_id", "month", "voucher", F.col("r.account").alias("account"), F.col("r.amount").alias("amount")
    )


def _row_finding(hits: DataFrame, code: str) -> DataFrame:
    return finding(
        hits,
        code,
        review=F.col("month"),
        key=[F.col("voucher"), F.col("account")],
        vouchers=F.array("voucher"),
        accounts=F.array("account"),
        amount=F.col("amount"),
    )


@control("AML_LARGE_CASH")
def large_cash(ctx: Context) -> DataFrame:
    limit = ctx.param("AML_LARGE_CASH", "threshold")
    return _row_finding(_rows(ctx).where(R.CASH.on(F.col("account")) & (F.abs("amount") >= limit)), "AML_LARGE_CASH")


@control("AML_ROUND_AMOUNTS_RELATED")
def round_related(ctx: Context) -> DataFrame:
    p = lambda n: ctx.param("AML_ROUND_AMOUNTS_RELATED", n)
    big = F.abs("amount") >= p("min_amount")
    even = F.abs("amount") % p("round_to") == 0
    return _row_finding(_rows(ctx).where(R.RELATED_AML.on(F.col("account")) & big & even), "AML_ROUND_AMOUNTS_RELATED")


def _flows(facts: DataFrame, min_amount: int) -> DataFrame:
    """Bank flows that can be part of a link: (company_id, month, side, date, amount, voucher); side ``in`` or ``out``."""
    bank = F.col("bank")
    into = (bank >= min_amount) & ~F.col("has_aml_customer")
    out = (bank <= -min_amount) & ~F.col("has_aml_supplier")
    flow = facts.where("NOT not_aml_flow").where(into | out)
    return flow.select("company_id", "month", F.when(into, "in").otherwise("out").alias("side"), F.col("voucher_date").alias("date"), F.abs(bank).alias("amount"), "voucher")


def rapid_in_out_links(facts: DataFrame, min_amount: int, max_days: int, tolerance_pct: int) -> DataFrame:
    """Every link between inflows not from customers and outflows not to suppliers of similar size soon after.

    Both sides are counted per company, day and amount before they meet: such a class is one row, named by its
    first voucher, and a link between two classes stands for ``n_in * n_out`` pairs of vouchers; the vouchers
    of the classes are in ``rapid_in_out_members``. Classes meet on company, day and amount class (the inflow
    looks at its own and the neighbouring classes), and the exact tolerance is tested on those.
    """
    level = lambda c: F.floor(F.log(c.cast("double")) / F.log(F.lit(_CLASS))).cast("int")
    classes = _flows(facts, min_amount).groupBy("company_id", "month", "side", "date", "amount").agg(F.count("*").alias("n"), F.min("voucher").alias("voucher"))
    classes = classes.withColumn("level", level(F.col("amount")))
    named = lambda side, p: [F.col("date").alias(f"{p}_date"), F.col("amount").alias(f"{p}_amount"), F.col("n").alias(f"n_{p}"), F.col("voucher").alias(f"{p}_voucher")]  # noqa: E731, ARG005
    inflow = classes.where("side = 'in'").select("company_id", "month", "level", *named("in", "in"))
    asked = inflow.withColumn("days", F.explode(F.sequence(F.lit(0), F.lit(max_days)))).withColumn("level", F.explode(F.array(*[F.col("level") + k for k in (-1, 0, 1)])))
    asked = asked.withColumn("out_date", F.expr("date_add(in_date, days)"))
    outflow = classes.where("side = 'out'").select("company_id", "level", *named("out", "out"))
    near = asked.join(outflow, ["company_id", "out_date", "level"]).where(F.abs(F.col("out_amount") - F.col("in_amount")) * 100 <= F.col("in_amount") * tolerance_pct)
    return near.select("company_id", "month", "in_voucher", "in_date", "in_amount", "n_in", "out_voucher", "out_date", "out_amount", "n_out", "days")


def rapid_in_out_members(facts: DataFrame, links: DataFrame, min_amount: int) -> DataFrame:
    """The vouchers of all linked classes: (company_id, side, date, amount, class_voucher, voucher)."""
    key = ["company_id", "side", "date", "amount"]
    ends = [links.select("company_id", F.lit(p).alias("side"), F.col(f"{p}_date").alias("date"), F.col(f"{p}_amount").alias("amount"), F.col(f"{p}_voucher").alias("class_voucher")) for p in ("in", "out")]
    return _flows(facts, min_amount).join(ends[0].unionByName(ends[1]).distinct(), key).select(*key, "class_voucher", "voucher")


@control("AML_RAPID_IN_OUT")
def rapid_in_out(ctx: Context) -> DataFrame:
    p = lambda n: ctx.param("AML_RAPID_IN_OUT", n)
    hits = rapid_in_out_links(ctx.facts, p("min_amount"), p("max_days"), p("tolerance_pct"))
    return finding(
        hits,
        "AML_RAPID_IN_OUT",
        review=F.col("month"),
        key=[F.col("in_voucher"), F.col("out_voucher")],
        vouchers=F.array("in_voucher", "out_voucher"),
        amount=F.col("in_amount"),
        variant=F.concat_ws("x", "n_in", "n_out"),
    )
