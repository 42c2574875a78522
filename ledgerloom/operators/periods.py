"""Periods, their months, comparison periods and series — all as column arithmetic.

A period row carries ``kind, period, start, end, n_months``. Period figures are always reached by
exploding to months and joining on (company, month); no range join is needed.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Month names used in labels, and the longest series of each kind.
MONTH_NAMES = ("jan", "feb", "mar", "apr", "maj", "jun", "jul", "aug", "sep", "okt", "nov", "dec")
SERIES_LIMITS = {"months": 36, "quarters": 16, "fiscal_years": 10, "same_month": 10, "ytd": 10, "r12": 36}

_SPEC = {
    "month": re.compile(r"(\d{4})-(\d{2})"),
    "quarter": re.compile(r"(\d{4})-Q([1-4])", re.IGNORECASE),
    "ytd": re.compile(r"YTD:(\d{4})-(\d{2})", re.IGNORECASE),
    "rolling": re.compile(r"R(\d{1,2}):(\d{4})-(\d{2})", re.IGNORECASE),
    "fy": re.compile(r"FY:(\d{4})-(\d{2})", re.IGNORECASE),
    "custom": re.compile(r"(\d{4}-\d{2}-\d{2})\.\.(\d{4}-\d{2}-\d{2})"),
}


def period_spec(kind: Column, start: Column, end: Column, n: Column) -> Column:
    """The text form of a period, e.g. ``2026-09``, ``2026-Q3``, ``YTD:2026-09``, ``R12:2026-09``."""
    ym = F.date_format(end, "yyyy-MM")
    return (
        F.when(kind == "month", ym)
        .when(kind == "quarter", F.concat(F.year(end).cast("string"), F.lit("-Q"), F.quarter(end).cast("string")))
        .when(kind == "ytd", F.concat(F.lit("YTD:"), ym))
        .when(kind == "fy", F.concat(F.lit("FY:"), F.date_format(start, "yyyy-MM")))
        .when(kind == "rolling", F.concat(F.lit("R"), n.cast("string"), F.lit(":"), ym))
        .otherwise(F.concat(start.cast("string"), F.lit(".."), end.cast("string")))
    )


def short_label(kind: Column, start: Column, end: Column, n: Column) -> Column:
    """Short heading of a period: ``sep 2026``, ``Q3 2026``, ``2025/26``, ``jan–sep 2026``."""
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    sm, em = F.element_at(names, F.month(start)), F.element_at(names, F.month(end))
    sy, ey = F.year(start).cast("string"), F.year(end).cast("string")
    whole = (F.month(start) == 1) & (F.dayofmonth(start) == 1) & (sy == ey)
    return (
        F.when(kind == "month", F.concat_ws(" ", em, ey))
        .when(kind == "quarter", F.concat(F.lit("Q"), F.quarter(end).cast("string"), F.lit(" "), ey))
        .when(kind == "fy", F.when(whole, sy).otherwise(F.concat(sy, F.lit("/"), F.substring(ey, 3, 2))))
        .when(kind == "rolling", F.concat(F.lit("R"), n.cast("string"), F.lit(" "), em, F.lit(" "), ey))
        .when(sy == ey, F.concat(sm, F.lit("–"), em, F.lit(" "), ey))
        .otherwise(F.concat(sm, F.lit(" "), sy, F.lit("–"), em, F.lit(" "), ey))
    )


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("period", period_spec(F.col("kind"), F.col("start"), F.col("end"), F.col("n_months"))).select(
        "company_id", "kind", "period", "start", "end", "n_months"
    )


def standard_periods(coverage: DataFrame, kinds: tuple[str, ...], rolling: int = 12) -> DataFrame:
    """Every period of the wanted kinds that ends in a fiscal month of the company."""
    one = {
        "month": "named_struct('kind','month','start',month,'end',last_day(month),'n_months',1)",
        "quarter": "CASE WHEN month(month) % 3 = 0 THEN named_struct('kind','quarter','start',add_months(month,-2),"
        "'end',last_day(month),'n_months',3) END",
        "ytd": "named_struct('kind','ytd','start',fy_start,'end',last_day(month),"
        "'n_months',CAST(months_between(month, trunc(fy_start,'MM')) AS INT) + 1)",
        "fy": "CASE WHEN month = trunc(fy_end,'MM') THEN named_struct('kind','fy','start',fy_start,'end',fy_end,"
        "'n_months',CAST(months_between(month, trunc(fy_start,'MM')) AS INT) + 1) END",
        "rolling": f"named_struct('kind','rolling','start',add_months(month,-{rolling - 1}),'end',last_day(month),"
        f"'n_months',{rolling})",
    }
    structs = ", ".join(one[k] for k in kinds)
    return _finish(
        coverage.select("company_id", F.expr(f"inline(array_compact(array({structs})))"))
    )


def custom_period(companies: DataFrame, start: str, end: str) -> DataFrame:
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    n = F.size(F.sequence(F.trunc(s, "MM"), F.trunc(e, "MM"), F.expr("interval 1 month")))
    return _finish(
        companies.select("company_id", F.lit("custom").alias("kind"), s.alias("start"), e.alias("end"), n.alias("n_months"))
    )


def parse_spec(spec: str, fy_month: int = 1) -> tuple[str, date, int]:
    """(kind, any day in the last month — start for fy — and month count) of a period text."""
    s = spec.strip()
    for kind, pattern in _SPEC.items():
        m = pattern.fullmatch(s)
        if not m:
            continue
        if kind == "custom":
            return kind, date.fromisoformat(m.group(2)), 0
        if kind == "rolling":
            return kind, date(int(m.group(2)), int(m.group(3)), 1), int(m.group(1))
        if kind == "quarter":
            return kind, date(int(m.group(1)), 3 * int(m.group(2)), 1), 3
        return kind, date(int(m.group(1)), int(m.group(2)), 1), 12 if kind == "fy" else 1
    raise ValueError(f"unknown period: {spec!r}")


def periods_for(spec: str, coverage: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """The period a text names, for every company."""
    kind, last, n = parse_spec(spec)
    if kind == "custom":
        start, end = spec.strip().split("..")
        return custom_period(coverage.select("company_id").distinct() if companies is None else companies, start, end)
    if kind == "fy":
        inside = coverage.where((F.trunc("fy_start", "MM") == F.lit(last)) & (F.col("month") == F.trunc("fy_end", "MM")))
    else:
        inside = coverage.where(F.col("month") == F.lit(last))
    return standard_periods(inside, (kind,), n if kind == "rolling" else 12)


def period_months(periods: DataFrame) -> DataFrame:
    return periods.select(
        "company_id",
        "period",
        F.explode(F.expr("sequence(trunc(start, 'MM'), trunc(end, 'MM'), interval 1 month)")).alias("month"),
    )


def same_period_previous_year(periods: DataFrame, fiscal_years: DataFrame | None = None) -> DataFrame:
    """Pairs each period with the same period a year before (fiscal years: the year before it)."""
    p = periods
    if fiscal_years is not None:
        prev = fiscal_years.select(
            "company_id", F.date_add("fy_end", 1).alias("start"), F.col("fy_start").alias("pfs"), F.col("fy_end").alias("pfe")
        )
        p = p.join(prev, ["company_id", "start"], "left")
    else:
        p = p.withColumn("pfs", F.lit(None).cast("date")).withColumn("pfe", F.lit(None).cast("date"))
    start = F.when(F.col("kind") == "fy", F.coalesce("pfs", F.add_months("start", -12))).otherwise(F.add_months("start", -12))
    back = F.add_months("end", -12)
    end = (
        F.when(F.col("kind") == "fy", F.coalesce("pfe", F.date_sub("start", 1)))
        .when((F.col("kind") != "custom") | (F.col("end") == F.last_day("end")), F.last_day(back))
        .otherwise(back)
    )
    return _pair(p.withColumn("c_start", start).withColumn("c_end", end))


def previous_period(periods: DataFrame, fiscal_years: DataFrame | None = None) -> DataFrame:
    """Pairs month, quarter and rolling periods with the one just before; others a year back."""
    shifting = F.col("kind").isin("month", "quarter", "rolling")
    moved = _pair(
        periods.where(shifting)
        .withColumn("c_start", F.expr("add_months(start, -n_months)"))
        .withColumn("c_end", F.expr("last_day(add_months(start, -1))"))
    )
    return moved.unionByName(same_period_previous_year(periods.where(~shifting), fiscal_years))


def _pair(df: DataFrame) -> DataFrame:
    n = F.size(F.expr("sequence(trunc(c_start, 'MM'), trunc(c_end, 'MM'), interval 1 month)"))
    spec = period_spec(F.col("kind"), F.col("c_start"), F.col("c_end"), F.col("c_n"))
    return df.withColumn("c_n", n).select(
        "company_id", "kind", "period", "start", "end", "n_months", spec.alias("compare"), "c_start", "c_end", "c_n"
    )


def compare_side(pairs: DataFrame) -> DataFrame:
    """The comparison periods of a pair table, as periods."""
    return pairs.select(
        "company_id",
        "kind",
        F.col("compare").alias("period"),
        F.col("c_start").alias("start"),
        F.col("c_end").alias("end"),
        F.col("c_n").alias("n_months"),
    ).distinct()


def period_coverage(periods: DataFrame, coverage: DataFrame, annual_years: DataFrame | None = None) -> DataFrame:
    """Per period: does every month have data, and which months are missing.

    A year known only as year balances counts as covered when the period is exactly that year.
    """
    j = period_months(periods).join(coverage.select("company_id", "month", "covered"), ["company_id", "month"], "left")
    gone = ~F.coalesce("covered", F.lit(False))
    out = j.groupBy("company_id", "period").agg(
        F.max(gone).alias("any_missing"),
        F.array_sort(F.collect_list(F.when(gone, F.date_format("month", "yyyy-MM")))).alias("missing_months"),
    )
    out = periods.join(out, ["company_id", "period"])
    if annual_years is None:
        return out.select(*periods.columns, (~F.col("any_missing")).alias("has_data"), "missing_months")
    yearly = annual_years.select("company_id", F.col("fy_start").alias("start"), F.col("fy_end").alias("end"), F.lit(True).alias("an"))
    out = out.join(yearly, ["company_id", "start", "end"], "left")
    whole = F.coalesce("an", F.lit(False)) & F.col("any_missing")
    return out.select(
        *periods.columns,
        (~F.col("any_missing") | whole).alias("has_data"),
        F.when(whole, F.array().cast("array<string>")).otherwise(F.col("missing_months")).alias("missing_months"),
        whole.alias("annual_only"),
    )


def validate_pairs(pairs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Is a comparison fair: same kind and length, both sides fully covered, and not the same span."""
    cov = lambda side, flag: period_coverage(side, coverage).select(
        "company_id", "period", F.col("has_data").alias(flag), F.array_join("missing_months", ",").alias(flag + "_missing")
    )
    cur = cov(pairs.select("company_id", "kind", "period", "start", "end", "n_months").distinct(), "cur")
    cmp_ = cov(compare_side(pairs), "cmp").withColumnRenamed("period", "compare")
    ok = F.col("cur") & F.col("cmp") & (F.col("n_months") == F.col("c_n")) & (
        (F.col("kind") != "custom") | (F.col("start") != F.col("c_start")) | (F.col("end") != F.col("c_end"))
    )
    return (
        pairs.join(cur, ["company_id", "period"])
        .join(cmp_, ["company_id", "compare"])
        .select(
            *pairs.columns,
            F.when(ok, "CALCULATED").otherwise("INSUFFICIENT_DATA").alias("pair_status"),
            F.col("cur_missing").alias("missing"),
            F.col("cmp_missing").alias("compare_missing"),
        )
    )


def period_series(anchors: DataFrame, kind: str, count: int, fiscal_years: DataFrame) -> DataFrame:
    """``count`` periods in ascending order that end with the anchor month (company_id, month)."""
    if not 2 <= count <= SERIES_LIMITS[kind]:
        raise ValueError(f"{kind}: between 2 and {SERIES_LIMITS[kind]} periods")
    back = anchors.select("company_id", F.col("month").alias("anchor"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    pos = (F.lit(count) - F.col("i")).alias("pos")
    shape = {
        "months": ("month", "add_months(anchor, -i)", "last_day(add_months(anchor, -i))", "1"),
        "quarters": (
            "quarter",
            "add_months(trunc(anchor, 'quarter'), -3 * i)",
            "last_day(add_months(trunc(anchor, 'quarter'), -3 * i + 2))",
            "3",
        ),
        "same_month": ("month", "add_months(anchor, -12 * i)", "last_day(add_months(anchor, -12 * i))", "1"),
        "r12": ("rolling", "add_months(anchor, -i - 11)", "last_day(add_months(anchor, -i))", "12"),
    }
    if kind in shape:
        k, s, e, n = shape[kind]
        rows = back.select("company_id", "anchor", pos, F.lit(k).alias("kind"), F.expr(s).alias("start"), F.expr(e).alias("end"), F.expr(n).alias("n_months"))
    else:
        w = Window.partitionBy("company_id").orderBy("fy_start")
        years = fiscal_years.select("company_id", "fy_start", "fy_end", F.row_number().over(w).alias("rk"))
        here = anchors.select("company_id", F.col("month").alias("anchor")).join(years, "company_id").where(
            F.col("anchor").between(F.trunc("fy_start", "MM"), F.col("fy_end"))
        ).select("company_id", "anchor", F.col("rk").alias("ark"), F.expr("CAST(months_between(anchor, trunc(fy_start, 'MM')) AS INT)").alias("off"))
        rows = here.join(years, "company_id").where(F.col("rk").between(F.col("ark") - count + 1, F.col("ark")))
        end = F.col("fy_end") if kind == "fiscal_years" else F.expr("least(last_day(add_months(fy_start, off)), fy_end)")
        rows = rows.select(
            "company_id",
            "anchor",
            (F.col("rk") - F.col("ark") + count).alias("pos"),
            F.lit("fy" if kind == "fiscal_years" else "ytd").alias("kind"),
            F.col("fy_start").alias("start"),
            end.alias("end"),
        ).withColumn("n_months", F.expr("CAST(months_between(trunc(end, 'MM'), trunc(start, 'MM')) AS INT) + 1"))
    spec = period_spec(F.col("kind"), F.col("start"), F.col("end"), F.col("n_months"))
    return rows.withColumn("period", spec).select("company_id", "anchor", "pos", "kind", "period", "start", "end", "n_months")


def open_notices(periods: DataFrame, latest: DataFrame) -> DataFrame:
    """Periods that reach beyond the company's data horizon, with it (``latest``: see ``ledger.latest_data``)."""
    known = latest.where("horizon IS NOT NULL").select("company_id", "horizon")
    return periods.join(known, "company_id").where(F.col("end") > F.col("horizon")).select("company_id", "kind", "period", "end", "horizon")
