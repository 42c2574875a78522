"""A ledger derived from the trade tables (orders, customer, lineitem, part).

Every order is a sales voucher (series B) and, when fulfilled, a payment (series C); every line
item is a purchase, payroll, asset, loan or accrual voucher depending on the part. Dates are moved
forward 27 years so the dated rates apply. Deviations the controls look for follow from key
remainders, so they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L

YEARS_FORWARD = 27
_ROWS = "array<struct<account:int,amount:bigint,text:string,status:string>>"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(account: str, amount: str, status: str = "normal") -> str:
    return (
        f"named_struct('account', CAST({account} AS INT), 'amount', CAST({amount} AS BIGINT), "
        f"'text', CAST(NULL AS STRING), 'status', '{status}')"
    )


def _voucher(series: str, number: str, date: str, reg: str, text: str, rows: str) -> str:
    return (
        f"named_struct('series', '{series}', 'number', {number}, 'voucher_date', {date}, 'reg_date', {reg}, "
        f"'text', {text}, 'rows', {rows})"
    )


def _orders(spark: SparkSession, sf_dir: str, text: bool) -> DataFrame:
    names = ["c_name"] if text else []
    customer = _table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("company_id"), F.expr("c_nationkey % 5 = 0").alias("food"), *names
    )
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        "o_custkey",
        F.col("o_orderstatus").alias("st"),
        F.expr("CAST(round(o_totalprice * 100) AS BIGINT)").alias("net"),
        F.expr(f"add_months(CAST(o_orderdate AS DATE), {12 * YEARS_FORWARD})").alias("d"),
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def sales_vouchers(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    name = "c_name" if text else "''"
    base = (
        _orders(spark, sf_dir, text)
        .withColumn("low", F.expr("food AND k % 7 = 0"))
        .withColumn("vat", F.expr("CASE WHEN k % 89 = 0 THEN net * 30 WHEN low THEN net * 12 ELSE net * 25 END div 100"))
        .withColumn("gross", F.expr("net + vat + CASE WHEN k % 211 = 0 THEN 100 ELSE 0 END"))
    )
    sale = _voucher(
        "B",
        "CAST(k AS STRING)",
        "d",
        "date_add(d, CAST(k % 60 AS INT))",
        f"concat('Kundfaktura ', {name})",
        f"CASE WHEN k % 13 = 0 THEN array({_row('1510', 'gross')}, {_row('3001', '-net')}, "
        f"{_row('CASE WHEN low THEN 2621 ELSE 2611 END', '-vat')}, {_row('3001', '100', 'removed')}) "
        f"ELSE array({_row('1510', 'gross')}, {_row('3001', '-net')}, "
        f"{_row('CASE WHEN low THEN 2621 ELSE 2611 END', '-vat')}) END",
    )
    payment = _voucher(
        "C",
        "CAST(k AS STRING)",
        "date_add(d, 30)",
        "date_add(d, CAST(30 + k % 9 AS INT))",
        f"concat('Inbetalning ', {name})",
        f"array({_row('CASE WHEN k % 53 = 0 THEN 1910 ELSE 1930 END', 'gross')}, {_row('1510', '-gross')})",
    )
    both = f"CASE WHEN st = 'F' THEN array({sale}, {payment}) ELSE array({sale}) END"
    return base.select("company_id", F.expr(f"inline({both})"))


def purchase_vouchers(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("company_id")
    )
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # Orders meet their customers first, so that the many lines are not shuffled once more for them.
    buyers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "company_id")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_type", *(["p_brand", "p_name"] if text else []))
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        "l_returnflag",
        F.expr("CAST(round(l_extendedprice * 100) AS BIGINT)").alias("net"),
        F.expr(f"add_months(CAST(l_shipdate AS DATE), {12 * YEARS_FORWARD})").alias("d"),
    )
    base = (
        lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("pk") == F.col("p_partkey"))
        .withColumn(
            "kind",
            F.expr(
                "CASE WHEN p_type = 'STANDARD' AND pk % 100 = 3 THEN 'reserve' WHEN p_type = 'STANDARD' THEN 'payroll' "
                "WHEN p_type = 'ECONOMY' AND pk % 60 = 0 THEN 'inflow' WHEN p_type = 'PROMO' AND pk % 40 = 0 THEN 'loan' "
                "ELSE 'invoice' END"
            ),
        )
        .withColumn(
            "acc",
            F.expr(
                "CASE p_type WHEN 'ECONOMY' THEN 4010 WHEN 'LARGE' THEN CASE WHEN sk % 10 = 0 THEN 6310 ELSE 5010 END "
                "WHEN 'MEDIUM' THEN CASE WHEN pk % 90 = 1 THEN 6993 ELSE 6110 END WHEN 'PROMO' THEN 6540 "
                "WHEN 'SMALL' THEN CASE WHEN pk % 50 = 0 THEN 1220 ELSE 6550 END END"
            ),
        )
        .withColumn("credit", F.expr("CASE WHEN p_type = 'MEDIUM' AND pk % 70 = 0 THEN 2999 ELSE 2440 END"))
        .withColumn(
            "vat", F.expr("CASE WHEN sk % 23 = 0 THEN net * 30 WHEN sk % 29 = 0 THEN net * 3 ELSE net * 25 END div 100")
        )
        .withColumn("tax", F.expr("net * 30 div 100"))
        .withColumn("contr", F.expr("CASE WHEN sk % 20 = 0 THEN net * 4000 ELSE net * 3142 END div 10000"))
        .withColumn("round_amt", F.expr("(net div 1000000) * 1000000 + 1000000"))
        .withColumn("out_amt", F.expr("net * 3 - net * 3 div 50"))
        .withColumn("num", F.expr("concat_ws('-', l_orderkey, l_linenumber, pk, sk, date_format(d, 'yyyyMMdd'))"))
        .withColumn("reg", F.expr("date_add(d, CAST(pk % 50 AS INT))"))
    )
    if text:
        base = base.withColumn(
            "party",
            F.expr(
                "CASE WHEN pk % 11 = 0 THEN 'Diverse inköp' WHEN sk % 5 = 0 THEN concat('Autogiro ', p_name) "
                "ELSE concat('Leverantörsfaktura ', p_brand, ' AB nr ', l_orderkey) END"
            ),
        )
    else:
        base = base.withColumn("party", F.lit(""))

    def one(series: str, label: str, rows: str, date: str = "d", reg: str = "reg", number: str = "num") -> str:
        return _voucher(series, number, date, reg, label, f"array({rows})")

    invoice_rows = f"{_row('acc', 'net')}, {_row('2641', 'vat')}, {_row('credit', '-(net + vat)')}"
    invoice = one("D", "party", invoice_rows)
    reversal = one(
        "A",
        "concat('Rättelse ', party)",
        f"{_row('acc', '-net')}, {_row('2641', '-vat')}, {_row('credit', 'net + vat')}",
        "date_add(d, 3)",
        "date_add(reg, 3)",
    )
    copy = _voucher(
        "D",
        "concat(num, '-K')",
        "date_add(d, CASE WHEN sk % 3 = 0 THEN 0 ELSE 5 END)",
        "date_add(reg, CASE WHEN sk % 3 = 0 THEN 0 ELSE 5 END)",
        "CASE WHEN sk % 2 = 0 THEN party ELSE concat(party, ' (2)') END",
        f"array({invoice_rows})",
    )
    payroll = one(
        "L",
        "'Lön'",
        f"{_row('7210', 'net')}, {_row('2710', '-tax')}, {_row('1930', '-(net - tax)')}, "
        f"{_row('7510', 'contr')}, {_row('2731', '-contr')}",
    )
    tax_in = one("A", "'Skattekonto inbetalning'", f"{_row('1630', 'round_amt')}, {_row('1930', '-round_amt')}", "date_add(d, 5)", "date_add(reg, 5)", "concat(num, '-S')")
    tax_out = one("A", "'Skattekonto dragning'", f"{_row('2710', 'round_amt')}, {_row('1630', '-round_amt')}", "date_add(d, 12)", "date_add(reg, 12)", "concat(num, '-T')")
    vacation = one("A", "'Semesterlöneskuld'", f"{_row('7290', 'net * 12 div 100')}, {_row('2920', '-(net * 12 div 100)')}", number="concat(num, '-V')")
    wages = (
        f"array_compact(array({payroll}, CASE WHEN sk % 4 = 0 THEN {tax_in} WHEN sk % 4 = 1 THEN {tax_out} END, "
        f"CASE WHEN CAST(company_id AS INT) % 4 = 1 AND month(d) NOT BETWEEN 6 AND 8 THEN {vacation} END))"
    )
    reserve = one("A", "'Avsättning periodiseringsfond'", f"{_row('8811', 'net')}, {_row('2120', '-net')}")
    loan = one("A", "'Lån delägare'", f"{_row('1685', 'round_amt')}, {_row('1930', '-round_amt')}")
    inflow = one("A", "'Insättning ägare'", f"{_row('1930', 'net * 3')}, {_row('2893', '-net * 3')}")
    outflow = one(
        "A",
        "'Utbetalning ägare'",
        f"{_row('2393', 'out_amt')}, {_row('1930', '-out_amt')}",
        "date_add(d, 2)",
        "date_add(reg, 2)",
    )
    vouchers = (
        f"CASE kind WHEN 'payroll' THEN {wages} WHEN 'reserve' THEN array({reserve}) "
        f"WHEN 'loan' THEN array({loan}) WHEN 'inflow' THEN array({inflow}, {outflow}) "
        f"ELSE CASE WHEN l_returnflag = 'R' AND pk % 37 = 0 THEN array({invoice}, {reversal}) "
        f"WHEN pk % 83 = 0 THEN array({invoice}, {copy}) ELSE array({invoice}) END END"
    )
    return base.select("company_id", F.expr(f"inline({vouchers})"))


def _shaped(inlined: DataFrame) -> DataFrame:
    return inlined.select(
        "company_id",
        F.trunc("voucher_date", "year").alias("fy_start"),
        "series",
        "number",
        "voucher_date",
        "reg_date",
        "text",
        "rows",
    )


def vouchers(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """The nested voucher table; ``text=False`` leaves out the joins that only serve the texts."""
    return _shaped(sales_vouchers(spark, sf_dir, text).unionByName(purchase_vouchers(spark, sf_dir, text)))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vouchers of series B only, which need orders and customers but no order lines."""
    return _shaped(sales_vouchers(spark, sf_dir)).where("series = 'B'")


def postings(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    return L.postings(vouchers(spark, sf_dir, text))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.monthly_movements(vouchers(spark, sf_dir, text=False))


# ---------------------------------------------------------------------------------- dimensions
def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(
        n.cast("string").alias("company_id"),
        F.col("n_name").alias("name"),
        F.expr("concat('5560', lpad(CAST(n_nationkey AS STRING), 2, '0'), '-', '1234')").alias("org_number"),
        F.when(n % 9 == 4, "EF").otherwise("AB").alias("legal_form"),
        F.expr("element_at(array('month', 'quarter', 'year'), CAST(n_nationkey % 3 AS INT) + 1)").alias("vat_period"),
        (n % 5 == 0).alias("food_retail"),
        F.lit(500_000).cast("bigint").alias("materiality"),
        (n % 4 == 0).alias("has_overdraft"),
        F.expr("CASE WHEN n_nationkey % 8 = 0 THEN array('A', 'C') END").alias("manual_series"),
        F.expr("CASE WHEN n_nationkey % 10 = 0 THEN array(2893) ELSE CAST(array() AS array<int>) END").alias(
            "suspense_accounts"
        ),
    )


# The chart of accounts of the derived ledger.
CHART = {
    1220: "Inventarier",
    1510: "Kundfordringar",
    1630: "Skattekonto",
    1685: "Fordran delägare",
    1910: "Kassa",
    1930: "Företagskonto",
    2081: "Aktiekapital",
    2091: "Balanserat resultat",
    2099: "Årets resultat",
    2120: "Periodiseringsfond Tax 2021",
    2393: "Lån från delägare",
    2440: "Leverantörsskulder",
    2611: "Utgående moms 25 %",
    2621: "Utgående moms 12 %",
    2641: "Ingående moms",
    2710: "Personalskatt",
    2731: "Arbetsgivaravgifter",
    2893: "Skuld till närstående",
    2920: "Upplupna semesterlöner",
    2999: "OBS-konto",
    3001: "Försäljning",
    4010: "Varuinköp",
    5010: "Lokalhyra",
    6110: "Kontorsmaterial",
    6310: "Företagsförsäkring",
    6540: "IT-tjänster",
    6550: "Konsultarvoden",
    7210: "Löner tjänstemän",
    7290: "Förändring av semesterlöneskuld",
    7510: "Arbetsgivaravgifter",
    8811: "Avsättning periodiseringsfond",
}


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ", ".join(f"named_struct('account', {a}, 'name', '{n}')" for a, n in CHART.items())
    return _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("company_id"), F.expr(f"inline(array({entries}))")
    )


def fiscal_years(movements: DataFrame) -> DataFrame:
    """Calendar years from first to last voucher; one company group lacks a month."""
    span = movements.groupBy("company_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    years = span.select(
        "company_id",
        "lo",
        "hi",
        F.explode(F.expr("sequence(trunc(lo, 'year'), trunc(hi, 'year'), interval 1 year)")).alias("fy_start"),
    )
    return years.select(
        "company_id",
        "fy_start",
        F.expr("date_sub(add_months(fy_start, 12), 1)").alias("fy_end"),
        F.lit(True).alias("has_vouchers"),
        F.expr("CASE WHEN fy_start = trunc(lo, 'year') THEN 'known' ELSE 'missing' END").alias("opening_status"),
        F.expr(
            "filter(sequence(fy_start, add_months(fy_start, 11), interval 1 month), "
            "m -> m <= hi AND NOT (CAST(company_id AS INT) % 7 = 3 AND m = DATE'2024-05-01'))"
        ).alias("covered_months"),
    )


def year_balances(movements: DataFrame, years: DataFrame) -> DataFrame:
    """IB of the first year; one company group also has an IB for 2025 that is 500 kr off on 1510."""
    first = years.where(F.col("opening_status") == "known").select(
        "company_id",
        "fy_start",
        F.lit("IB").alias("kind"),
        F.expr(
            "inline(array(named_struct('account', 1930, 'amount', 10000000L), "
            "named_struct('account', 2081, 'amount', -5000000L), named_struct('account', 2091, 'amount', -5000000L)))"
        ),
    )
    off = F.col("company_id").cast("int") % 6 == 1
    carried = (
        movements.where(off & (F.col("month") < F.lit("2025-01-01").cast("date")))
        .select("company_id", F.expr("CASE WHEN account < 3000 THEN account ELSE 2099 END").alias("account"), "amount")
        .unionByName(first.where(off).select("company_id", "account", "amount"))
        .unionByName(
            first.where(off & (F.col("account") == 1930)).select(
                "company_id", F.lit(1510).alias("account"), F.lit(50_000).cast("bigint").alias("amount")
            )
        )
        .groupBy("company_id", "account")
        .agg(F.sum("amount").alias("amount"))
        .select(
            "company_id",
            F.lit("2025-01-01").cast("date").alias("fy_start"),
            F.lit("IB").alias("kind"),
            "account",
            "amount",
        )
    )
    return first.unionByName(carried)


def budget(movements: DataFrame) -> DataFrame:
    """Budget of a month: the same month a year before, plus ten percent."""
    return movements.where("account BETWEEN 3000 AND 8989").select(
        "company_id",
        F.expr("trunc(add_months(month, 12), 'year')").alias("fy_start"),
        F.lit("PBUDGET").alias("kind"),
        F.add_months("month", 12).alias("month"),
        "account",
        F.expr("amount * 11 div 10").alias("amount"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed names for every fourth brand."""
    brands = _table(spark, sf_dir, "part").select("p_brand").distinct()
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    return brands.where(number.cast("int") % 4 == 0).select(
        F.lit(None).cast("string").alias("company_id"),
        F.concat(F.lit("brand "), number).alias("key"),
        F.concat(F.lit("Märke "), number).alias("canonical_name"),
    )


def delivered_files(fiscal_years: DataFrame) -> DataFrame:
    """Files of each company and year: a summary, full exports of some years, and partial exports that overlap."""
    n = "(CAST(company_id AS INT) + year(fy_start))"
    day = lambda months, days: f"date_add(add_months(fy_start, {months}), {days})"
    file = lambda name, order, kind, lo, hi, when: f"CASE WHEN {when} THEN struct('{name}' AS file, {order} AS ord, '{kind}' AS kind, {lo} AS lo, {hi} AS hi) END"
    files = ", ".join(
        (
            file("summary", 9, "summary", "fy_start", "fy_end", "true"),
            file("old", 1, "full", "fy_start", "fy_end", f"{n} % 4 = 0"),
            file("spring", 2, "partial", day(2, 9), day(5, 19), f"{n} % 2 = 0"),
            file("full", 3, "full", "fy_start", "fy_end", f"{n} % 3 = 1"),
            file("summer", 4, "partial", day(4, 0), day(8, 29), f"{n} % 5 < 3"),
            file("june", 5, "partial", day(5, 0), day(5, 29), f"{n} % 7 < 4"),
        )
    )
    return fiscal_years.select("company_id", "fy_start", F.expr(f"inline(array_compact(array({files})))"))


def mixed_kinds(fiscal_years: DataFrame) -> DataFrame:
    """Fiscal years with what is known of each: ``vouchers``, ``psaldo`` (period balances) or ``annual`` (year balances)."""
    n, year = F.col("company_id").cast("int") % 5, F.year("fy_start")
    last = F.max("fy_start").over(Window.partitionBy("company_id"))
    kind = (
        F.when(n == 1, "psaldo")
        .when((n == 2) & (F.col("fy_start") < last), "annual")
        .when(n == 3, F.element_at(F.array(F.lit("vouchers"), F.lit("psaldo"), F.lit("annual")), year % 3 + 1))
        .otherwise("vouchers")
    )
    return fiscal_years.withColumn("kind", kind).withColumn("has_vouchers", F.col("kind") == "vouchers").withColumn("covered_months", F.lit(None).cast("array<date>"))


def mixed_amounts(movements: DataFrame, kinds: DataFrame, openings: DataFrame, balances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Period and year balances of the years without vouchers, from the true openings and month-end balances.

    Some months and rows are left out; every other such year states its own opening balance.
    """
    years = kinds.select("company_id", "fy_start", "fy_end", "kind", "opening_status")
    inside = movements.join(years, "company_id").where("month BETWEEN fy_start AND fy_end")
    result = inside.where("kind = 'psaldo' AND account >= 3000").select("company_id", "fy_start", "month", "account", "amount")
    moved = inside.where("kind = 'psaldo' AND account < 3000").select("company_id", "fy_start", "month", "account")
    at_end = moved.join(balances, ["company_id", "fy_start", "month", "account"], "left").select("company_id", "fy_start", "month", "account", F.coalesce("balance", F.lit(0)).alias("amount"))
    at_end = at_end.where("NOT (account % 10 = 0 AND month(month) = 11)")
    periods = result.unionByName(at_end).where("NOT (CAST(company_id AS INT) % 5 = 3 AND month(month) = 7)").withColumn("kind", F.lit("PSALDO"))
    stated = years.where("opening_status <> 'missing' OR (kind <> 'vouchers' AND year(fy_start) % 2 = 0)")
    ib = openings.join(stated.select("company_id", "fy_start"), ["company_id", "fy_start"], "left_semi").select("company_id", "fy_start", F.lit("IB").alias("kind"), "account", "amount")
    res = inside.where("kind = 'annual' AND account >= 3000").groupBy("company_id", "fy_start", "account").agg(F.sum("amount").alias("amount")).withColumn("kind", F.lit("RES"))
    ends = years.where("kind = 'annual'").select("company_id", "fy_start", F.trunc("fy_end", "MM").alias("month"))
    ub = balances.join(ends, ["company_id", "fy_start", "month"]).select("company_id", "fy_start", F.lit("UB").alias("kind"), "account", F.col("balance").alias("amount"))
    return periods, ib.unionByName(res).unionByName(ub)


def tax_statement(booked: DataFrame) -> DataFrame:
    """The authority's view of the tax account: most booked rows up to four days later, and some interest."""
    part = lambda k: F.split(F.split("id", r"\|")[1], "-")[k].cast("bigint")
    seen = booked.where(part(0) % 7 != 0).select("company_id", F.date_add("date", (part(2) % 5).cast("int")).alias("date"), "amount", "id")
    interest = booked.where(part(0) % 11 == 0).select("company_id", F.date_add("date", 1).alias("date"), F.lit(1500).cast("bigint").alias("amount"), F.concat("id", F.lit("|R")).alias("id"))
    return seen.unionByName(interest)


# ------------------------------------------------------------------------- imports and reviews
IMPORT_RANGE = ("2025-03-10", "2025-06-20")


def imports(vouchers: DataFrame) -> list[DataFrame]:
    """Three imports of the sales vouchers: a first one, a corrected one, and a partial one."""
    from ledgerloom.operators.voucher_facts import content_hash

    sales = vouchers.where("series = 'B'").withColumn("k", F.col("number").cast("bigint"))
    text = F.col("text")

    def version(df: DataFrame, new_text) -> DataFrame:
        return df.withColumn("text", new_text).withColumn("content_hash", content_hash()).select(
            "company_id", "fy_start", "series", "number", "voucher_date", "content_hash"
        )

    first = version(sales.where("k % 20 <> 0"), F.when(F.col("k") % 15 == 1, F.concat(text, F.lit(" (prel)"))).otherwise(text))
    second = version(sales.where("k % 17 <> 3"), text)
    lo, hi = IMPORT_RANGE
    third = version(
        sales.where(F.col("voucher_date").between(lo, hi)).where("k % 19 <> 4"),
        F.when(F.col("k") % 23 == 5, F.concat(text, F.lit(" (rättad)"))).otherwise(text),
    )
    return [first, second, third]


def deliveries(vouchers: DataFrame) -> list[DataFrame]:
    """The sales vouchers as they arrive: most of them, some of these provisional; corrections and the rest; some again."""
    sales = vouchers.where("series = 'B'").withColumn("k", F.col("number").cast("bigint"))
    columns = vouchers.columns
    double = F.transform("rows", lambda r: r.withField("amount", r["amount"] * 2))
    early = sales.where("k % 20 <> 0").select(
        *[c for c in columns if c not in ("text", "voucher_date", "rows")],
        F.when(F.col("k") % 15 == 1, F.concat("text", F.lit(" (prel)"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") % 31 == 5, F.col("fy_start")).otherwise(F.col("voucher_date")).alias("voucher_date"),
        F.when(F.col("k") % 31 == 5, double).otherwise(F.col("rows")).alias("rows"),
    )
    late = sales.where("k % 20 = 0 OR k % 15 = 1 OR k % 31 = 5")
    return [df.select(*columns) for df in (early, late, sales.where("k % 10 = 3"))]


def import_scopes(fiscal_years: DataFrame) -> list[DataFrame]:
    whole = fiscal_years.select("company_id", "fy_start", F.col("fy_start").alias("lo"), F.col("fy_end").alias("hi"))
    lo, hi = IMPORT_RANGE
    part = fiscal_years.where("year(fy_start) = 2025").select(
        "company_id", "fy_start", F.lit(lo).cast("date").alias("lo"), F.lit(hi).cast("date").alias("hi")
    )
    return [whole, whole, part]


def records(candidates: DataFrame) -> DataFrame:
    """Finding records of earlier runs: most candidates, with a status from their fingerprint."""
    digit = F.substring("fingerprint", 2, 1)
    status = (
        F.when(digit.isin(*"012345"), "NEW")
        .when(digit.isin(*"67"), "IN_PROGRESS")
        .when(digit.isin(*"89"), "ASK_CLIENT")
        .when(digit == "a", "AUTO_CLOSED")
        .when(digit.isin(*"bc"), "RESOLVED")
        .otherwise("ACCEPTED_OK")
    )
    latest = F.max_by(F.struct("severity", "period", "vouchers", "accounts", "amount"), "review")
    return (
        candidates.where(~F.substring("fingerprint", 1, 1).isin(*"01"))
        .groupBy("company_id", "fingerprint", "rule_code", "visibility")
        .agg(F.array_sort(F.collect_set("review")).alias("seen_in_reviews"), latest.alias("c"))
        .select("company_id", "fingerprint", "rule_code", "visibility", "c.*", "seen_in_reviews", status.alias("status"))
    )


def rerun(candidates: DataFrame) -> DataFrame:
    """What a later run of the reviews from 2024 on produces: some findings are gone."""
    return candidates.where("review >= '2024-01'").where(~F.substring("fingerprint", 1, 1).isin(*"ef"))


def suppressions(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES "
        "('s1', 'INPUT_VAT_RATIO', 'försäkring', DATE'2031-01-01', NULL, array(6310), NULL, NULL), "
        "('s2', 'OUTPUT_VAT_RATIO', 'småbelopp', NULL, NULL, NULL, NULL, 3000000L), "
        "('s3', 'AML_LARGE_CASH', 'får ej', NULL, NULL, NULL, NULL, NULL), "
        "('s4', 'INPUT_VAT_RATIO', 'gammal', DATE'2020-01-01', NULL, NULL, NULL, NULL), "
        "('s5', 'UNBALANCED_VOUCHER', 'öresavrundning', NULL, '3', NULL, 'balanserar inte B', NULL) "
        "AS s(id, rule_code, reason, expires_at, company_id, accounts, text_contains, max_amount)"
    )
