"""Tax-account reconciliation: the authority's statement against accounts 1630-1639.

Rows match one to one on equal amount within some days, inside a fiscal year, first come first served: both
sides go by date, then by their order in the file, and a statement row takes the first free ledger row near
enough. Since the days that a row may take only move forward, that is a queue: with ``p`` ledger rows of an
amount used or passed, a day of ``s`` statement rows passes those that lie before its window (``before`` in
number) and takes up to ``s`` of the rest of those up to its end (``upto``), so that afterwards

    p' = min(upto, max(p, before) + s).

Rows are therefore counted per day first, and what remains is the state ``p``, carried from day to day. Such
steps compose to ``min(most, max(p, least) + plus)``: days are folded in chunks, the chunks' three numbers are
folded in a second pass, and then each chunk runs from its own start. A hot amount is a row per day, and no
task goes through its rows one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.ranges import Accounts, accounts

TAX_ACCOUNT: Accounts = accounts((1630, 1639))
#: Days between a statement row and its ledger row; days of a chunk.
TOLERANCE, CHUNK = 3, 64

_KEY = ["company_id", "fy_start", "amount"]
_ENDLESS = (1 << 62) - 1


def booked_rows(facts: DataFrame) -> DataFrame:
    """(company_id, fy_start, date, amount, id) of the rows on the tax account; id: voucher and row."""
    rows = facts.select("company_id", "fy_start", "series", "number", F.col("voucher_date").alias("date"), F.posexplode("eff").alias("row_no", "r"))
    rows = rows.where(TAX_ACCOUNT.on(F.col("r.account")))
    return rows.select("company_id", "fy_start", "date", F.col("r.amount").alias("amount"), F.concat_ws("|", "series", "number", F.col("row_no").cast("string")).alias("id"))


def in_years(statement: DataFrame, fiscal_years: DataFrame) -> DataFrame:
    """Statement rows with the fiscal year they fall in; rows outside all years have none."""
    years = fiscal_years.select("company_id", "fy_start", "fy_end")
    named = statement.withColumn("year", F.year("date")).alias("s")
    spans = years.select("*", F.explode(F.expr("sequence(year(fy_start), year(fy_end))")).alias("year")).alias("y")
    hit = F.expr("s.company_id = y.company_id AND s.year = y.year AND s.date BETWEEN y.fy_start AND y.fy_end")
    return named.join(spans, hit, "left").select("s.company_id", "y.fy_start", "s.date", "s.amount", "s.id")


def _day(date: str) -> Column:
    return F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))


def _fold(steps: str, start: str) -> str:
    """SQL of the state after ``steps`` from ``start`` and, for every step, where it began to take and how many."""
    taken = "struct(x.day AS day, greatest(s.p, x.before) AS place, least(x.upto - greatest(s.p, x.before), x.s) AS n)"
    after = "least(x.upto, greatest(s.p, x.before) + x.s)"
    kind = "array<struct<day:int,place:bigint,n:bigint>>"
    return f"aggregate({steps}, struct({start} AS p, CAST(array() AS {kind}) AS out), (s, x) -> struct({after} AS p, concat(s.out, array({taken})) AS out), s -> s.out)"


def _summary(steps: str) -> str:
    """SQL of the three numbers that a run of days composes to."""
    return (
        f"aggregate({steps}, struct(0L AS least, 0L AS plus, {_ENDLESS}L AS most), (s, x) -> struct("
        "greatest(s.least, x.before - s.plus) AS least, s.plus + x.s AS plus, least(x.upto, greatest(s.most, x.before) + x.s) AS most))"
    )


def taken(statement: DataFrame, booked: DataFrame, tolerance: int = TOLERANCE, chunk: int = CHUNK) -> DataFrame:
    """(company_id, fy_start, amount, date, place, n): each day's first n statement rows take the ledger rows from ``place`` on."""
    count = lambda df, name: df.groupBy(*_KEY, "date").agg(F.count("*").alias(name))
    days = count(statement, "s").join(count(booked, "l"), [*_KEY, "date"], "full_outer").na.fill(0, ["s", "l"]).withColumn("day", _day("date"))
    over = Window.partitionBy(*_KEY).orderBy("day")  # a row per day
    upto = lambda last: F.coalesce(F.sum("l").over(over.rangeBetween(Window.unboundedPreceding, last)), F.lit(0))
    days = days.withColumns({"before": upto(-tolerance - 1), "upto": upto(tolerance)}).where("s > 0")
    chunks = days.groupBy(*_KEY, F.expr(f"day div {chunk}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("day", "s", "before", "upto"))).alias("steps"))
    chunks = chunks.withColumn("sum", F.expr(_summary("steps")))
    queue = chunks.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("chunk", "sum"))).alias("chunks"))
    starts = F.expr(
        "aggregate(chunks, struct(0L AS p, CAST(array() AS array<struct<chunk:bigint,p:bigint>>) AS out), (s, x) -> struct("
        "least(x.sum.most, greatest(s.p, x.sum.least) + x.sum.plus) AS p, concat(s.out, array(struct(x.chunk AS chunk, s.p AS p))) AS out), s -> s.out)"
    )
    starts = queue.select(*_KEY, F.inline(starts))
    return chunks.join(starts, [*_KEY, "chunk"]).select(*_KEY, F.inline(F.expr(_fold("steps", "p")))).withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))).drop("day")


def reconcile(statement: DataFrame, booked: DataFrame, tolerance: int = TOLERANCE, chunk: int = CHUNK) -> DataFrame:
    """Every row of both sides with its partner's id and date, or null.

    ``statement``/``booked``: company_id, fy_start, date, amount, id. Rows without a fiscal year match nothing.
    """
    within = Window.partitionBy(*_KEY, "date").orderBy("id")
    ranked = lambda df: df.where("fy_start IS NOT NULL").withColumn("r", F.row_number().over(within) - 1)
    found = taken(statement.where("fy_start IS NOT NULL"), booked, tolerance, chunk)
    first = booked.groupBy(*_KEY, "date").agg(F.count("*").alias("l"))
    first = first.withColumn("from", F.coalesce(F.sum("l").over(Window.partitionBy(*_KEY).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("l")
    ledger = ranked(booked).join(first, [*_KEY, "date"]).select(*_KEY, "date", "id", (F.col("from") + F.col("r")).alias("place"))
    asked = ranked(statement).join(found, [*_KEY, "date"], "left").select(*_KEY, "date", "id", F.expr("CASE WHEN r < n THEN place + r END").alias("place"))
    both = asked.select(*_KEY, "place", F.col("date").alias("s_date"), F.col("id").alias("s_id"), F.lit(True).alias("asked")).join(
        ledger.select(*_KEY, "place", F.col("date").alias("l_date"), F.col("id").alias("l_id"), F.lit(True).alias("booked")), [*_KEY, "place"], "full_outer"
    )
    side = lambda name, own, other: both.where(F.col("asked" if name == "statement" else "booked")).select(
        "company_id", "fy_start", F.lit(name).alias("side"), F.col(f"{own}_date").alias("date"), "amount", F.col(f"{own}_id").alias("id"), F.col(f"{other}_id").alias("partner"), F.col(f"{other}_date").alias("partner_date")
    )
    outside = statement.where("fy_start IS NULL").select(
        "company_id", "fy_start", F.lit("statement").alias("side"), "date", "amount", "id", F.lit(None).cast("string").alias("partner"), F.lit(None).cast("date").alias("partner_date")
    )
    return side("statement", "s", "l").unionByName(side("ledger", "l", "s")).unionByName(outside)


def status(matched: DataFrame, statement: DataFrame, balances: DataFrame, coverage: DataFrame, opening: int = 0) -> DataFrame:
    """Balances on both sides at every month end, their difference, and the year's rows that are open then.

    A row is open from its month on, until the month in which its partner is dated; so the rows open at a month
    end are those of a match over the rows up to that day.
    """
    months = coverage.select("company_id", "fy_start", "month")
    upto = Window.partitionBy("company_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    moved = statement.groupBy("company_id", F.trunc("date", "MM").alias("month")).agg(F.sum("amount").alias("moved"))
    early = moved.join(months.groupBy("company_id").agg(F.min("month").alias("first")), "company_id").select("company_id", F.greatest("month", "first").alias("month"), "moved")
    said = months.join(early.groupBy("company_id", "month").agg(F.sum("moved").alias("moved")), ["company_id", "month"], "left")
    said = said.select("company_id", "fy_start", "month", (F.lit(opening) + F.coalesce(F.sum("moved").over(upto), F.lit(0))).alias("statement_balance"))
    booked = balances.where(TAX_ACCOUNT.on(F.col("account"))).groupBy("company_id", "month").agg(F.sum("balance").alias("book_balance"))
    month, until = F.trunc("date", "MM"), F.trunc("partner_date", "MM")
    lasting = matched.where("fy_start IS NOT NULL").where(until.isNull() | (until > month))
    event = lambda at, sign: lasting.select("company_id", "fy_start", "side", at.alias("month"), F.lit(sign).alias("n"), (sign * F.col("amount")).alias("amount"))
    events = event(month, 1).unionByName(event(until, -1).where("month IS NOT NULL"))
    part = lambda name, c: F.sum(F.when(F.col("side") == name, F.col(c)).otherwise(0))
    changes = events.groupBy("company_id", "fy_start", "month").agg(*[part(s, c).alias(f"{s}_{c}") for s in ("statement", "ledger") for c in ("n", "amount")])
    year = Window.partitionBy("company_id", "fy_start").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    open_ = [F.coalesce(F.sum(f"{s}_{c}").over(year), F.lit(0)).alias(f"open_{s}_{c}") for s in ("statement", "ledger") for c in ("n", "amount")]
    out = said.join(booked, ["company_id", "month"], "left").join(changes, ["company_id", "fy_start", "month"], "left")
    book = F.coalesce("book_balance", F.lit(0))
    return out.select("company_id", "month", "statement_balance", book.alias("book_balance"), (book - F.col("statement_balance")).alias("difference"), *open_)
