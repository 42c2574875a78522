"""Spend per counterparty: recurrence, level shifts and the spend report.

Voucher rows are folded to (company, month, account, text key) before anything else; aliases,
counterparty keys and all series work on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.counterparty import UNKNOWN, counterparty, read_text
from ledgerloom.functions.ranges import EXTERNAL_SPEND, Accounts, cost_category
from ledgerloom.session import stage


def text_spend(vouchers: DataFrame, accounts: Accounts = EXTERNAL_SPEND) -> DataFrame:
    """Cost per company, month, account and normalised text; first occurrence kept as display name."""
    rows = (
        vouchers.select(
            "company_id",
            F.trunc("voucher_date", "MM").alias("month"),
            "voucher_date",
            "series",
            "number",
            F.col("text").alias("v_text"),
            F.posexplode("rows").alias("row_no", "r"),
        )
        .where(F.col("r.status") != "removed")
        .where(accounts.on(F.col("r.account")))
        .select("company_id", "month", "voucher_date", "series", "number", "v_text", "row_no", F.col("r.account").alias("account"), F.col("r.amount").alias("amount"), F.col("r.text").alias("r_text"))
    )
    read = read_text(read_text(rows, "r_text", "r_"), "v_text", "v_")
    first = F.struct("voucher_date", "series", "number", "row_no")
    return read.groupBy("company_id", "month", "account", "r_full", "v_full").agg(
        F.sum("amount").alias("amount"),
        F.count("*").alias("n_rows"),
        F.min(first).alias("first"),
        F.min_by("r_label", first).alias("r_label"),
        F.min_by("v_label", first).alias("v_label"),
    )


def spend_months(texts: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Cost per company, counterparty and month with accounts, and name and confidence first seen."""
    return (
        counterparty(texts, aliases)
        .groupBy("company_id", "cp_key", "month")
        .agg(
            F.sum("amount").alias("amount"),
            F.array_sort(F.collect_set("account")).alias("accounts"),
            F.min(F.struct("first", "cp_name", "cp_confidence", "cp_source")).alias("seen"),
        )
    )


def recurrence(active: Column, n: Column) -> Column:
    """Class of a month series from the sorted positions of its active months (at most a few dozen)."""
    k = F.size(active)
    gaps = F.when(k >= 2, F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.get(active, i) - F.get(active, i - 1)))
    recent = F.slice(gaps, F.greatest(k - 6, F.lit(1)), F.lit(6))
    return (
        F.when(k == 0, "unknown")
        .when(k == 1, F.when(n >= 6, "one_off").otherwise("unknown"))
        .when((k >= F.greatest(F.lit(3), F.floor(n * 0.75))) & F.forall(recent, lambda g: g == 1), "monthly")
        .when((k >= 3) & F.forall(gaps, lambda g: g == 3), "quarterly")
        .when(F.forall(gaps, lambda g: g == 12), "annual")
        .otherwise("irregular")
    )


#: Running totals of a counterparty up to a month: rows, cost, months with cost, their cost, squares.
_TOTALS = ("n", "sum", "pos", "pos_sum", "sq")


def calendar(coverage: DataFrame) -> DataFrame:
    """(company_id, month, idx): the months of a company, numbered from 1."""
    over = Window.partitionBy("company_id").orderBy("month")
    return coverage.select("company_id", "month").distinct().withColumn("idx", F.row_number().over(over))


def series(spend: DataFrame, months: DataFrame) -> DataFrame:
    """One row per counterparty: its months with cost, and running totals of every month from the first (``at``) on.

    What falls into a period is then the difference of two running totals, so a month of cost is neither copied
    nor shuffled for the periods that look at it. A company's calendar bounds the arrays.
    """
    rows = spend.join(months, ["company_id", "month"])
    who = ["company_id", "cp_key"]
    order = Window.partitionBy(*who).orderBy("idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    cost, big = F.col("amount") > 0, F.col("amount").cast("decimal(38,0)")
    totals = {
        "n": F.count("*").over(upto),
        "sum": F.sum("amount").over(upto),
        "pos": F.sum(F.when(cost, 1).otherwise(0)).over(upto),
        "pos_sum": F.sum(F.when(cost, F.col("amount")).otherwise(0)).over(upto),
        "sq": F.sum((big * big).cast("decimal(38,0)")).over(upto).cast("decimal(38,0)"),
    }
    rows = rows.withColumns(totals | {"next": F.coalesce(F.lead("idx").over(order), F.col("idx") + 1)})
    listed = F.array_sort(F.collect_list(F.struct("idx", "next", "month", "amount", F.struct(*_TOTALS).alias("upto"), "accounts", "seen")))
    out = rows.groupBy(*who).agg(listed.alias("active"))
    steps = F.flatten(F.transform("active", lambda x: F.array_repeat(x["upto"], x["next"] - x["idx"])))
    return out.select(*who, F.col("active")[0]["idx"].alias("at"), steps.alias("totals"), F.transform("active", lambda x: x.dropFields("next", "upto")).alias("active"))


def _between(total: str, first: str, last: str) -> str:
    """SQL of a total over the months ``first`` to ``last`` (null: none)."""
    zero = "CAST(0 AS DECIMAL(38,0))" if total == "sq" else "0L"
    upto = lambda i: f"CASE WHEN {i} < at THEN {zero} ELSE element_at(totals, CAST(least({i} - at + 1, size(totals)) AS INT)).{total} END"
    return f"CASE WHEN {last} IS NULL THEN {zero} ELSE {upto(last)} - {upto(f'({first} - 1)')} END"


def spans(pairs: DataFrame, months: DataFrame, history: int = 24) -> DataFrame:
    """Pairs with the numbers of their months: the history (``lo`` to ``hi``), its last year and quarter, both periods."""
    back = F.expr(f"sequence(add_months(trunc(end, 'MM'), -{history - 1}), trunc(end, 'MM'), interval 1 month)")
    seen = pairs.withColumn("month", F.explode(back)).join(months, ["company_id", "month"])
    pos = F.expr("12 - CAST(months_between(trunc(end, 'MM'), month) AS INT)")  # 1..12 in the last year
    inside = lambda a, b: F.col("month").between(F.trunc(a, "MM"), F.col(b))
    lowest = lambda test: F.min(F.when(test, F.col("idx")))
    return seen.groupBy("company_id", "period", "compare", "start", "end").agg(
        F.min("idx").alias("lo"),
        F.max("idx").alias("hi"),
        lowest(pos >= 1).alias("lo12"),
        lowest(pos >= 10).alias("lo3"),
        F.array_sort(F.collect_list(F.when(pos >= 1, pos))).alias("positions"),
        F.array_sort(F.collect_list("month")).alias("months"),
        *[f.alias(n) for n, f in (("s", lowest(inside("start", "end"))), ("e", F.max(F.when(inside("start", "end"), F.col("idx")))), ("cs", lowest(inside("c_start", "c_end"))), ("ce", F.max(F.when(inside("c_start", "c_end"), F.col("idx")))))],
    )


def spend_rows(pairs: DataFrame, spend: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per pair and counterparty: amount, comparison, recurrence, run rate, accounts and share."""
    months = calendar(coverage)
    keys = ["company_id", "period", "compare"]
    total = lambda name, first, last: F.expr(_between(name, first, last))
    met = series(spend, months).join(spans(pairs, months), "company_id").where(total("n", "lo", "hi") > 0)
    within = F.filter("active", lambda x: x["idx"].between(F.col("lo"), F.col("hi")))
    cost = F.filter("within", lambda x: x["amount"] > 0)
    recent = F.filter("cost", lambda x: x["idx"] >= F.col("lo12"))
    rows = (
        met.withColumn("within", within)
        .withColumn("cost", cost)
        .select(
            *keys,
            "cp_key",
            total("sum", "s", "e").alias("amount"),
            total("sum", "cs", "ce").alias("compare_amount"),
            F.transform(recent, lambda x: F.element_at("positions", x["idx"] - F.col("lo12") + 1)).alias("active"),
            total("pos_sum", "lo3", "CASE WHEN lo3 IS NOT NULL THEN hi END").alias("recent_sum"),
            total("pos", "lo3", "CASE WHEN lo3 IS NOT NULL THEN hi END").alias("recent_n"),
            F.expr("CASE WHEN size(cost) > 0 THEN cost[0].month END").alias("first_month"),
            F.array_sort(F.array_distinct(F.flatten("within.accounts"))).alias("accounts"),
            F.array_min("within.seen").alias("seen"),
            F.size("positions").alias("n12"),
        )
        .withColumn("recurrence", recurrence(F.col("active"), F.col("n12")))
        .withColumn("annualized", F.when((F.col("recurrence") == "monthly") & (F.col("recent_n") > 0), F.expr(money.ratio_half_up("recent_sum * 12", "recent_n", 1))))
    )
    rows = stage(rows, "spend_rows")  # the totals below read it a second time
    gross = rows.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), F.lit(0)).alias("gross"))
    return (
        rows.join(gross, keys)
        .withColumn("share", F.expr(f"CASE WHEN amount > 0 AND gross <> 0 THEN {money.ratio_half_even('amount', 'gross')} END"))
        .select(
            *keys,
            "cp_key",
            F.col("seen.cp_name").alias("name"),
            F.col("seen.cp_confidence").alias("confidence"),
            "amount",
            "compare_amount",
            (F.col("amount") - F.col("compare_amount")).alias("diff"),
            "share",
            "recurrence",
            "annualized",
            "accounts",
            F.array_sort(F.array_compact(F.array_distinct(F.transform("accounts", lambda a: cost_category(a))))).alias("categories"),
            "first_month",
            "gross",
        )
    )


def spend_listing(rows: DataFrame, kind: str, min_amount: int = 100_000, limit: int = 25) -> DataFrame:
    """The report's lists: ``largest``, ``new`` or ``disappeared`` counterparties, top ``limit``."""
    named = F.col("cp_key") != UNKNOWN
    if kind == "largest":
        picked, order = rows.where("amount <> 0 OR compare_amount <> 0"), "amount"
    elif kind == "new":
        picked, order = rows.where((F.col("amount") >= min_amount) & (F.col("compare_amount") == 0) & named), "amount"
    else:
        picked, order = rows.where((F.col("compare_amount") >= min_amount) & (F.col("amount") == 0) & named), "compare_amount"
    w = Window.partitionBy("company_id", "period", "compare").orderBy(F.desc(order), "cp_key")
    return picked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def concentration(rows: DataFrame) -> DataFrame:
    """Totals, share of the 1, 5 and 10 largest counterparties and the recurring share, in 0.1 %."""
    keys = ["company_id", "period", "compare"]
    w = Window.partitionBy(*keys).orderBy(F.desc("amount"), "cp_key")
    regular = F.col("recurrence").isin("monthly", "quarterly", "annual")
    totals = rows.groupBy(*keys).agg(
        F.sum("amount").alias("total"),
        F.sum("compare_amount").alias("compare_total"),
        F.max("gross").alias("gross"),
        F.coalesce(F.sum(F.when(regular, F.col("amount"))), F.lit(0)).alias("regular"),
    )
    # Ranks up to ten are limited before the shuffle.
    largest = rows.where("amount > 0").select(*keys, "cp_key", "amount").withColumn("rk", F.row_number().over(w)).where("rk <= 10")
    top = lambda n: F.sum(F.when(F.col("rk") <= n, F.col("amount")).otherwise(0)).alias(f"s{n}")
    agg = totals.join(largest.groupBy(*keys).agg(top(1), top(5), top(10)), keys, "left").fillna(0, ["s1", "s5", "s10"])
    pct = lambda c: F.expr(money.ratio_half_even(c, "gross"))
    return agg.select(
        *keys,
        "total",
        "compare_total",
        F.coalesce(pct("s1"), F.lit(0)).alias("top1"),
        F.coalesce(pct("s5"), F.lit(0)).alias("top5"),
        F.coalesce(pct("s10"), F.lit(0)).alias("top10"),
        pct("regular").alias("recurring_share"),
    )


def level_shifts(pairs: DataFrame, spend: DataFrame, coverage: DataFrame, min_active: int = 6, min_side: int = 3, history: int = 24) -> DataFrame:
    """Best structural break of each counterparty's monthly series up to a pair's end.

    Sums and sums of squares on both sides are differences of exact running totals; a break needs
    ``min_side`` months on both sides, a change of at least 20 % and a distance of three mean
    deviations. The earliest of the strongest breaks wins.
    """
    keys = ["company_id", "period", "compare", "cp_key"]
    months = calendar(coverage)
    total = lambda name, first, last: F.expr(_between(name, first, last))
    met = series(spend, months).join(spans(pairs, months, history), "company_id").where(total("pos", "lo", "hi") >= min_active)
    breaks = met.where(F.col("hi") - F.col("lo") + 1 >= 2 * min_side).withColumn("b", F.explode(F.sequence(F.col("lo") + min_side, F.col("hi") - (min_side - 1))))
    d = lambda c: F.col(c).cast("double")
    exact = lambda name, first, last: total(name, first, last).cast("decimal(38,0)")
    s = (
        breaks.select(
            *keys,
            "start",
            "end",
            F.element_at("months", F.col("b") - F.col("lo") + 1).alias("month"),
            (F.col("b") - F.col("lo")).cast("bigint").alias("k"),
            (F.col("hi") - F.col("b") + 1).cast("bigint").alias("m"),
            exact("sum", "lo", "(b - 1)").alias("sa"),
            exact("sq", "lo", "(b - 1)").alias("qa"),
            exact("sum", "b", "hi").alias("sb"),
            exact("sq", "b", "hi").alias("qb"),
        )
        .where(F.col("sa") > 0)
        # all on the same scale: mean difference and deviations in öre
        .withColumn("delta", F.abs(d("sb") / d("m") - d("sa") / d("k")))
        .withColumn("dev_a", F.sqrt(F.expr("CAST(k * qa - sa * sa AS DOUBLE)")) / d("k"))
        .withColumn("dev_b", F.sqrt(F.expr("CAST(m * qb - sb * sb AS DOUBLE)")) / d("m"))
        .withColumn("noise", (F.col("dev_a") + F.col("dev_b")) / 2)
        .withColumn("stat", F.col("delta") / F.when(F.col("noise") == 0, F.lit(1e-7)).otherwise(F.col("noise")))
        .where(F.expr("abs(sb * k - sa * m) * 5 >= sa * m") & (F.col("stat") >= 3))
    )
    best = s.groupBy(*keys, "start", "end").agg(
        F.max_by(F.struct("month", "sa", "k", "sb", "m"), F.struct(F.col("stat"), (-F.col("k")).alias("neg_k"))).alias("b")
    )
    return best.select(
        *keys,
        "start",
        "end",
        F.col("b.month").alias("shift_month"),
        F.expr(money.ratio_half_up("b.sa", "b.k", 1)).alias("before"),
        F.expr(money.ratio_half_up("b.sb", "b.m", 1)).alias("after"),
    ).withColumn("change_pct", F.expr(f"CASE WHEN before <> 0 THEN {money.ratio_half_even('(after - before)', 'before')} ELSE 0 END"))


def report_shifts(shifts: DataFrame) -> DataFrame:
    """Shifts shown in a spend report: from the period's start to one period length after its end."""
    upper = F.expr("date_add(end, datediff(end, start))")
    return shifts.where((F.col("shift_month") >= F.col("start")) & (F.col("shift_month") <= upper))


# ------------------------------------------------------------------------------ candidates
def recurring_changes(rows: DataFrame, full_history: DataFrame) -> DataFrame:
    """Confirmed recurring costs that are new, changed or gone (alias-confirmed, a full year of data).

    ``full_history``: company_id, period with twelve voucher months up to the period's end.
    """
    kronor = 100_000
    change = F.col("amount") - F.col("compare_amount")
    gone = (F.col("amount") < kronor) & (F.col("compare_amount") >= kronor)
    small = (F.col("amount") < kronor) & ~gone
    slight = (F.col("compare_amount") != 0) & (
        (F.abs(change) < kronor) | (F.abs(change) * 5 < F.abs("compare_amount"))
    ) & ~gone
    regular = F.col("recurrence").isin("monthly", "quarterly", "annual")
    return (
        rows.join(full_history, ["company_id", "period"], "left_semi")
        .where((F.col("confidence") >= 98) & regular & ~small & ~slight)
        .select(
            "company_id",
            "period",
            "compare",
            "cp_key",
            F.when(gone, "gone").when(F.col("compare_amount") == 0, "new").otherwise("changed").alias("kind"),
            F.when(gone, -F.col("compare_amount")).when(F.col("compare_amount") != 0, change).otherwise(F.col("amount")).alias("effect"),
            "recurrence",
            "accounts",
        )
    )


def frequency_changes(changes: DataFrame, pairs: DataFrame, voucher_counts: DataFrame) -> DataFrame:
    """Of the recurring changes of monthly pairs: clearly more or fewer vouchers than before."""
    c = voucher_counts
    cur = c.select("company_id", F.date_format("month", "yyyy-MM").alias("period"), "cp_key", F.col("n_vouchers").alias("n_now"))
    prev = c.select("company_id", F.date_format("month", "yyyy-MM").alias("compare"), "cp_key", F.col("n_vouchers").alias("n_before"))
    month = pairs.where("kind = 'month'").select("company_id", "period", "compare")
    j = (
        changes.join(month, ["company_id", "period", "compare"])
        .join(cur, ["company_id", "period", "cp_key"], "left")
        .join(prev, ["company_id", "compare", "cp_key"], "left")
        .na.fill(0, ["n_now", "n_before"])
        .withColumn("change", F.col("n_now") - F.col("n_before"))
    )
    return j.where((F.abs("change") >= 2) & ((F.col("n_before") == 0) | (F.abs("change") * 2 >= F.col("n_before")))).select(
        "company_id", "period", "compare", "cp_key", "n_now", "n_before", "change"
    )


def counterparty_vouchers(vouchers: DataFrame, aliases: DataFrame | None, accounts: Accounts = EXTERNAL_SPEND) -> DataFrame:
    """Distinct vouchers per company, counterparty and month.

    A voucher's rows are reduced to its distinct text keys inside the record, so counting needs no
    distinct over vouchers.
    """
    with_rows = vouchers.select(
        "company_id",
        F.trunc("voucher_date", "MM").alias("month"),
        F.col("text").alias("v_text"),
        F.explode(
            F.array_distinct(
                F.transform(
                    F.filter("rows", lambda r: (r["status"] != "removed") & accounts.on(r["account"])), lambda r: F.coalesce(r["text"], F.lit(""))
                )
            )
        ).alias("r_text"),
    )
    read = read_text(read_text(with_rows, "r_text", "r_"), "v_text", "v_")
    folded = read.groupBy("company_id", "month", "r_full", "v_full").agg(
        F.count("*").alias("n"), F.min("r_label").alias("r_label"), F.min("v_label").alias("v_label")
    )
    return counterparty(folded, aliases).groupBy("company_id", "cp_key", "month").agg(F.sum("n").alias("n_vouchers"))


def shift_references(shifts: DataFrame, vouchers: DataFrame, aliases: DataFrame, accounts: Accounts = EXTERNAL_SPEND, limit: int = 6) -> DataFrame:
    """The first vouchers of a shifted counterparty around its break: three months before it to two after.

    ``shifts``: company_id, period, cp_key, shift_month. Only counterparties named by an alias have references.
    """
    texts = F.array_distinct(F.transform(F.filter("rows", lambda r: (r["status"] != "removed") & accounts.on(r["account"])), lambda r: F.coalesce(r["text"], F.lit(""))))
    rows = vouchers.select("company_id", F.trunc("voucher_date", "MM").alias("month"), "voucher_date", "series", "number", F.col("text").alias("v_text"), F.explode(texts).alias("r_text"))
    months = F.expr("sequence(add_months(shift_month, -3), add_months(shift_month, 2), interval 1 month)")
    wanted = shifts.select("company_id", "period", "cp_key", F.explode(months).alias("month"))
    near = rows.join(wanted.select("company_id", "month").distinct(), ["company_id", "month"], "left_semi")
    read = read_text(read_text(near, "r_text", "r_"), "v_text", "v_")
    folded = read.groupBy("company_id", "r_full", "v_full").agg(F.min("r_label").alias("r_label"), F.min("v_label").alias("v_label"))
    named = counterparty(folded, aliases).where("cp_source = 'alias'").select("company_id", "r_full", "v_full", "cp_key")
    hits = read.join(named, ["company_id", "r_full", "v_full"]).select("company_id", "month", "cp_key", "voucher_date", "series", "number").distinct()
    order = Window.partitionBy("company_id", "period", "cp_key").orderBy("voucher_date", "series", "number")
    found = hits.join(wanted, ["company_id", "month", "cp_key"]).withColumn("place", F.row_number().over(order))
    return found.where(F.col("place") <= limit).select("company_id", "period", "cp_key", "place", F.concat("series", "number").alias("voucher"), "voucher_date")


def exact_copies(vouchers: DataFrame, min_cost: int = 10_000) -> DataFrame:
    """Vouchers of one day with identical rows (texts ignored), at least ``min_cost`` of cost.

    One row per group of copies: its size, first and last voucher, cost and accounts; grouped by a
    hash of the sorted rows, so a large group is only counted.
    """
    eff = F.filter("rows", lambda r: r["status"] != "removed")
    fields = {f.name for f in vouchers.schema["rows"].dataType.elementType}
    more = [f for f in ("trans_date", "quantity", "objects") if f in fields]  # of ingested ledgers
    line = lambda r: F.concat_ws(":", r["account"].cast("string"), r["amount"].cast("string"), r["status"], *[F.coalesce(r[f].cast("string"), F.lit("")) for f in more])
    spelled = F.array_join(F.array_sort(F.transform(eff, line)), ";")
    cost = F.aggregate(
        F.filter(eff, lambda r: r["account"].between(4000, 7999)), F.lit(0).cast("bigint"), lambda a, r: a + r["amount"]
    )
    accs = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(eff, lambda r: r["account"]))), lambda a: a.cast("string")), ",")
    rows = vouchers.select(
        "company_id", "voucher_date", F.concat("series", "number").alias("voucher"), spelled.alias("spelled"), F.abs(cost).alias("cost"), accs.alias("accounts")
    ).where(F.col("cost") >= min_cost)
    return (
        rows.groupBy("company_id", "voucher_date", "spelled", "accounts", "cost")
        .agg(F.count("*").alias("n"), F.min("voucher").alias("first_voucher"), F.max("voucher").alias("last_voucher"))
        .where("n >= 2")
        .withColumn("pattern", F.substring(F.sha2("spelled", 256), 1, 20))
        .drop("spelled")
    )
