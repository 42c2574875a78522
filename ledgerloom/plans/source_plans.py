"""Registered queries over ledgers of several kinds of source: vouchers, period balances and year balances."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L
from ledgerloom.operators import versions as V
from ledgerloom.plans import oracle as O
from ledgerloom.plans.book import Book
from ledgerloom.sources import demo


class Mixed:
    """The book's ledger with some years known only by their balances."""

    def __init__(self, book: Book) -> None:
        self.book = book

    @cached_property
    def fiscal_years(self) -> DataFrame:
        return self.book.stage(demo.mixed_kinds(self.book.fiscal_years), "mixed_years")

    @cached_property
    def amounts(self) -> tuple[DataFrame, DataFrame]:
        whole = self.fiscal_years.withColumn("has_vouchers", F.lit(True))
        first = self.book.year_balances.join(whole.where("opening_status <> 'missing'").select("company_id", "fy_start"), ["company_id", "fy_start"], "left_semi")
        openings = self.book.stage(L.opening_balances(self.book.movements, L.opening_basis(whole, first), first), "mixed_true_openings")
        balances = L.balances(self.book.movements, L.month_coverage(whole), openings)
        periods, years = demo.mixed_amounts(self.book.movements, self.fiscal_years, openings, self.book.stage(balances, "mixed_true_balances"))
        return self.book.stage(periods, "mixed_periods"), self.book.stage(years, "mixed_year_balances")

    @cached_property
    def coverage(self) -> DataFrame:
        return self.book.stage(L.month_coverage(self.fiscal_years, *self.amounts), "mixed_coverage")

    @cached_property
    def booked(self) -> DataFrame:
        """Movements of the years with vouchers."""
        years = self.coverage.where("source = 'vouchers'").select("company_id", "month")
        return self.book.movements.join(years, ["company_id", "month"], "left_semi")

    @cached_property
    def movements(self) -> DataFrame:
        return self.book.stage(L.source_movements(self.booked, *self.amounts, self.coverage), "mixed_movements")

    @cached_property
    def basis(self) -> DataFrame:
        return self.book.stage(L.opening_basis(self.fiscal_years, self.amounts[1]), "mixed_basis")

    @cached_property
    def openings(self) -> DataFrame:
        return self.book.stage(L.opening_balances(self.movements, self.basis, self.amounts[1]), "mixed_openings")

    @cached_property
    def closed(self) -> DataFrame:
        return L.closings(self.amounts[1], self.coverage)


def _mixed(book: Book) -> Mixed:
    return book.__dict__.setdefault("mixed", Mixed(book))


def _month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("month", "yyyy-MM"))


def mixed_coverage(book: Book) -> DataFrame:
    """Where the figures of every fiscal month come from."""
    return _month(_mixed(book).coverage.select("company_id", "month", "source", F.col("covered").cast("int").alias("covered")))


def mixed_movements(book: Book) -> DataFrame:
    return _month(_mixed(book).movements.select("company_id", "month", "account", "amount"))


def mixed_openings(book: Book) -> DataFrame:
    return _mixed(book).openings.select("company_id", F.col("fy_start").cast("string").alias("fy_start"), "account", "amount")


def mixed_balances(book: Book) -> DataFrame:
    m = _mixed(book)
    return _month(L.balances(m.movements, m.coverage, m.openings, closed=m.closed).select("company_id", "month", "account", "balance"))


def mixed_completeness(book: Book) -> DataFrame:
    m = _mixed(book)
    return _month(L.balance_complete(m.coverage, m.basis, m.closed)).withColumn("balance_complete", F.col("balance_complete").cast("int"))


def mixed_balance_at(book: Book) -> DataFrame:
    """Balances on the 15th and on the last day of every fiscal month."""
    m = _mixed(book)
    days = m.coverage.select("company_id", F.explode(F.array(F.date_add("month", 14), F.last_day("month"))).alias("at"))
    booked = m.fiscal_years.where("has_vouchers").select("company_id", "fy_start")
    vouchers = book.vouchers.join(booked, ["company_id", "fy_start"], "left_semi")
    return L.balance_at(vouchers, m.movements, m.coverage, m.openings, days, m.closed).withColumn("at", F.col("at").cast("string"))


def mixed_years(book: Book) -> DataFrame:
    """Movement per account of every whole fiscal year and of its second half."""
    m = _mixed(book)
    years = m.coverage.select("company_id", "fy_start", "fy_end").distinct()
    span = lambda name, start: years.select("company_id", F.concat(F.lit(name), F.date_format("fy_start", "yyyy")).alias("period"), start.alias("start"), F.col("fy_end").alias("end"))
    periods = span("FY:", F.col("fy_start")).unionByName(span("H2:", F.add_months("fy_start", 6)))
    return L.period_movements(periods, m.movements, L.annual_movements(m.amounts[1], m.fiscal_years), m.coverage)


def mixed_result_to_date(book: Book) -> DataFrame:
    m = _mixed(book)
    return _month(L.result_to_date(m.movements, m.coverage, m.amounts[1]).select("company_id", "month", "account", "amount"))


def result_to_date(book: Book) -> DataFrame:
    """Result per account from the start of the fiscal year to every month end, without and with the closing entries."""
    parts = [L.result_to_date(book.movements, book.coverage, closing_entries=c).withColumn("closing_entries", F.lit(int(c))) for c in (False, True)]
    return _month(parts[0].unionByName(parts[1]).select("company_id", "month", "account", "amount", "closing_entries"))


def file_precedence(book: Book) -> DataFrame:
    """The file that counts for each stretch of days of a company and fiscal year."""
    found = V.file_precedence(demo.delivered_files(book.fiscal_years))
    return found.select("company_id", *[F.col(c).cast("string").alias(c) for c in ("fy_start", "lo", "hi")], "file")


QUERIES = {
    f.__name__: f
    for f in (file_precedence, mixed_coverage, mixed_movements, mixed_openings, mixed_balances, mixed_completeness, mixed_balance_at, mixed_years, mixed_result_to_date, result_to_date)
}

_MIX = """ky AS (SELECT company_id, fy_start, fy_end, fy_start = date_trunc('year', lo) AS first, year(fy_start) AS y,
  CASE CAST(company_id AS INTEGER) % 5 WHEN 1 THEN 'psaldo' WHEN 2 THEN CASE WHEN fy_start < date_trunc('year', hi) THEN 'annual' ELSE 'vouchers' END
   WHEN 3 THEN ['vouchers', 'psaldo', 'annual'][year(fy_start) % 3 + 1] ELSE 'vouchers' END AS kind FROM fy),
tq AS (SELECT company_id, fy_start, account, CAST(sum(amount) AS BIGINT) AS amount FROM (
  SELECT k.company_id, k.fy_start, i.account, i.amount FROM ky k, ib0 i
  UNION ALL SELECT k.company_id, k.fy_start, CASE WHEN m.account < 3000 THEN m.account ELSE 2099 END, m.amount FROM ky k JOIN mm m ON m.company_id = k.company_id AND m.month < k.fy_start AND m.account < 9000)
 GROUP BY ALL HAVING sum(amount) <> 0),
mk AS (SELECT m.*, k.fy_start, k.fy_end, k.kind, k.first, k.y FROM mm m JOIN ky k ON k.company_id = m.company_id AND m.month BETWEEN k.fy_start AND k.fy_end),
ps AS (SELECT company_id, fy_start, month, account, amount FROM mk WHERE kind = 'psaldo' AND account >= 3000 AND NOT (CAST(company_id AS INTEGER) % 5 = 3 AND month(month) = 7)
 UNION ALL SELECT a.company_id, a.fy_start, a.month, a.account, CAST(coalesce((SELECT amount FROM tq WHERE tq.company_id = a.company_id AND tq.fy_start = a.fy_start AND tq.account = a.account), 0) + sum(b.amount) AS BIGINT)
  FROM mk a JOIN mk b ON b.company_id = a.company_id AND b.fy_start = a.fy_start AND b.account = a.account AND b.month <= a.month WHERE a.kind = 'psaldo' AND a.account < 3000
   AND NOT (a.account % 10 = 0 AND month(a.month) = 11) AND NOT (CAST(a.company_id AS INTEGER) % 5 = 3 AND month(a.month) = 7) GROUP BY a.company_id, a.fy_start, a.month, a.account),
iy AS (SELECT company_id, fy_start FROM ky WHERE first OR (kind <> 'vouchers' AND y % 2 = 0)),
ub AS (SELECT company_id, fy_start, account, CAST(sum(amount) AS BIGINT) AS amount FROM (SELECT t.company_id, t.fy_start, t.account, t.amount FROM tq t JOIN ky k ON k.company_id = t.company_id AND k.fy_start = t.fy_start AND k.kind = 'annual'
  UNION ALL SELECT company_id, fy_start, account, amount FROM mk WHERE kind = 'annual' AND account < 3000) GROUP BY ALL HAVING sum(amount) <> 0),
rs AS (SELECT company_id, fy_start, account, CAST(sum(amount) AS BIGINT) AS amount FROM mk WHERE kind = 'annual' AND account >= 3000 GROUP BY ALL),
cv AS (SELECT c.company_id, c.fy_start, c.fy_end, c.month, CASE k.kind WHEN 'vouchers' THEN 'vouchers' WHEN 'annual' THEN 'annual' ELSE CASE WHEN EXISTS (SELECT 1 FROM ps WHERE ps.company_id = c.company_id AND ps.month = c.month) THEN 'psaldo' ELSE 'none' END END AS source
 FROM cov c JOIN ky k ON k.company_id = c.company_id AND k.fy_start = c.fy_start),
mv AS (SELECT company_id, fy_start, month, account, amount FROM mk WHERE kind = 'vouchers'
 UNION ALL SELECT * FROM (SELECT p.company_id, p.fy_start, p.month, p.account, CAST(CASE WHEN p.account >= 3000 THEN p.amount ELSE p.amount - coalesce(lag(p.amount) OVER (PARTITION BY p.company_id, p.fy_start, p.account ORDER BY p.month), t.amount, 0) END AS BIGINT) AS amount
  FROM ps p LEFT JOIN (SELECT tq.* FROM tq JOIN iy USING (company_id, fy_start)) t ON t.company_id = p.company_id AND t.fy_start = p.fy_start AND t.account = p.account) WHERE amount <> 0),
kd AS (SELECT *, CASE WHEN own THEN 'ib' WHEN pk = 'annual' THEN 'ub' WHEN pk = 'vouchers' THEN 'derived' ELSE 'none' END AS opens FROM (
  SELECT k.*, iy.fy_start IS NOT NULL AS own, lag(kind) OVER (PARTITION BY k.company_id ORDER BY k.fy_start) AS pk, lag(k.fy_start) OVER (PARTITION BY k.company_id ORDER BY k.fy_start) AS pfy
  FROM ky k LEFT JOIN iy ON iy.company_id = k.company_id AND iy.fy_start = k.fy_start)),
an AS (SELECT k.*, (SELECT max(a.fy_start) FROM kd a WHERE a.company_id = k.company_id AND a.fy_start <= k.fy_start AND a.opens <> 'derived') AS anchor FROM kd k),
kn AS (SELECT a.*, b.opens <> 'none' AS known, b.opens AS how, b.pfy AS apfy FROM an a JOIN kd b ON b.company_id = a.company_id AND b.fy_start = a.anchor),
op AS (SELECT company_id, fy_start, account, CAST(sum(amount) AS BIGINT) AS amount FROM (
  SELECT k.company_id, k.fy_start, t.account, t.amount FROM kn k JOIN tq t ON t.company_id = k.company_id AND t.fy_start = k.anchor WHERE k.how = 'ib'
  UNION ALL SELECT k.company_id, k.fy_start, u.account, u.amount FROM kn k JOIN ub u ON u.company_id = k.company_id AND u.fy_start = k.apfy WHERE k.how = 'ub'
  UNION ALL SELECT k.company_id, k.fy_start, 2099, -u.amount FROM kn k JOIN ub u ON u.company_id = k.company_id AND u.fy_start = k.apfy WHERE k.how = 'ub'
  UNION ALL SELECT k.company_id, k.fy_start, CASE WHEN m.account < 3000 THEN m.account ELSE 2099 END, m.amount FROM kn k JOIN mv m ON m.company_id = k.company_id AND m.month >= k.anchor AND m.month < k.fy_start AND m.account < 9000 WHERE k.known)
 GROUP BY ALL HAVING sum(amount) <> 0),
be AS (SELECT company_id, month, fy_start, account, CAST(sum(amount) AS BIGINT) AS balance FROM (
  SELECT c.company_id, c.month, c.fy_start, o.account, o.amount FROM cv c JOIN op o ON o.company_id = c.company_id AND o.fy_start = c.fy_start
  UNION ALL SELECT c.company_id, c.month, c.fy_start, m.account, m.amount FROM cv c JOIN mv m ON m.company_id = c.company_id AND m.fy_start = c.fy_start AND m.month <= c.month AND m.account < 3000)
 GROUP BY ALL HAVING sum(amount) <> 0),
ed AS (SELECT DISTINCT u.company_id, u.fy_start, CAST(date_trunc('month', k.fy_end) AS DATE) AS month FROM ub u JOIN ky k ON k.company_id = u.company_id AND k.fy_start = u.fy_start),
bx AS (SELECT b.company_id, b.month, b.account, b.balance FROM be b LEFT JOIN ed ON ed.company_id = b.company_id AND ed.month = b.month WHERE ed.month IS NULL
 UNION ALL SELECT u.company_id, ed.month, u.account, u.amount FROM ub u JOIN ed ON ed.company_id = u.company_id AND ed.fy_start = u.fy_start)"""

SQL = {
    "file_precedence": O.query(
        """SELECT company_id, strftime(fy_start, '%Y-%m-%d') AS fy_start, strftime(min(d), '%Y-%m-%d') AS lo, strftime(max(d), '%Y-%m-%d') AS hi, file FROM (
 SELECT *, d - CAST(row_number() OVER (PARTITION BY company_id, fy_start, file ORDER BY d) AS INTEGER) AS island FROM (
  SELECT company_id, fy_start, d, CASE WHEN n % 7 < 4 AND d BETWEEN CAST(fy_start + INTERVAL 5 MONTH AS DATE) AND CAST(fy_start + INTERVAL 5 MONTH AS DATE) + 29 THEN 'june'
   WHEN n % 5 < 3 AND d BETWEEN CAST(fy_start + INTERVAL 4 MONTH AS DATE) AND CAST(fy_start + INTERVAL 8 MONTH AS DATE) + 29 THEN 'summer' WHEN n % 3 = 1 THEN 'full'
   WHEN n % 2 = 0 AND d BETWEEN CAST(fy_start + INTERVAL 2 MONTH AS DATE) + 9 AND CAST(fy_start + INTERVAL 5 MONTH AS DATE) + 19 THEN 'spring' WHEN n % 4 = 0 THEN 'old'
   WHEN NOT (n % 4 = 0 OR n % 2 = 0 OR n % 3 = 1 OR n % 5 < 3 OR n % 7 < 4) THEN 'summary' END AS file
  FROM (SELECT company_id, fy_start, CAST(company_id AS INTEGER) + year(fy_start) AS n, CAST(unnest(generate_series(CAST(fy_start AS TIMESTAMP), CAST(fy_end AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM fy)) WHERE file IS NOT NULL)
 GROUP BY company_id, fy_start, file, island"""
    ),
    "mixed_coverage": O.query("SELECT company_id, strftime(month, '%Y-%m') AS month, source, CAST(source IN ('vouchers', 'psaldo') AS INTEGER) AS covered FROM cv", _MIX),
    "mixed_movements": O.query("SELECT company_id, strftime(month, '%Y-%m') AS month, account, amount FROM mv", _MIX),
    "mixed_openings": O.query("SELECT company_id, strftime(fy_start, '%Y-%m-%d') AS fy_start, account, amount FROM op", _MIX),
    "mixed_balances": O.query("SELECT company_id, strftime(month, '%Y-%m') AS month, account, balance FROM bx", _MIX),
    "mixed_completeness": O.query(
        """SELECT c.company_id, strftime(c.month, '%Y-%m') AS month, CAST((any_value(k.known) AND bool_and(d.source IN ('vouchers', 'psaldo'))) OR any_value(ed.month IS NOT NULL) AS INTEGER) AS balance_complete
 FROM cv c JOIN cv d ON d.company_id = c.company_id AND d.fy_start = c.fy_start AND d.month <= c.month JOIN kn k ON k.company_id = c.company_id AND k.fy_start = c.fy_start
 LEFT JOIN ed ON ed.company_id = c.company_id AND ed.month = c.month GROUP BY c.company_id, c.month""",
        _MIX,
    ),
    "mixed_balance_at": O.query(
        """SELECT company_id, strftime("at", '%Y-%m-%d') AS "at", account, CAST(sum(amount) AS BIGINT) AS balance FROM (
 SELECT company_id, last_day(month) AS "at", account, balance AS amount FROM bx
 UNION ALL SELECT c.company_id, CAST(c.month + 14 AS DATE), o.account, o.amount FROM cv c JOIN op o ON o.company_id = c.company_id AND o.fy_start = c.fy_start
 UNION ALL SELECT c.company_id, CAST(c.month + 14 AS DATE), m.account, m.amount FROM cv c JOIN mv m ON m.company_id = c.company_id AND m.fy_start = c.fy_start AND m.account < 3000 AND (m.month < c.month OR (m.month = c.month AND c.source = 'psaldo'))
 UNION ALL SELECT c.company_id, CAST(c.month + 14 AS DATE), p.account, p.amount FROM cv c JOIN p ON p.company_id = c.company_id AND p.month = c.month AND p.account < 3000 AND p.vdate <= c.month + 14 WHERE c.source = 'vouchers')
 GROUP BY ALL HAVING sum(amount) <> 0""",
        _MIX,
    ),
    "mixed_years": O.query(
        """SELECT company_id, period, account, CAST(sum(amount) AS BIGINT) AS amount FROM (
 SELECT m.company_id, 'FY:' || k.y AS period, m.account, m.amount FROM mv m JOIN ky k ON k.company_id = m.company_id AND k.fy_start = m.fy_start
 UNION ALL SELECT m.company_id, 'H2:' || k.y, m.account, m.amount FROM mv m JOIN ky k ON k.company_id = m.company_id AND k.fy_start = m.fy_start WHERE m.month >= k.fy_start + INTERVAL 6 MONTH
 UNION ALL SELECT r.company_id, 'FY:' || year(r.fy_start), r.account, r.amount FROM rs r
 UNION ALL SELECT u.company_id, 'FY:' || year(u.fy_start), u.account, u.amount FROM ub u JOIN iy ON iy.company_id = u.company_id AND iy.fy_start = u.fy_start
 UNION ALL SELECT t.company_id, 'FY:' || k.y, t.account, -t.amount FROM tq t JOIN iy ON iy.company_id = t.company_id AND iy.fy_start = t.fy_start JOIN ky k ON k.company_id = t.company_id AND k.fy_start = t.fy_start AND k.kind = 'annual')
 GROUP BY ALL HAVING sum(amount) <> 0""",
        _MIX,
    ),
    "mixed_result_to_date": O.query(
        """SELECT company_id, strftime(month, '%Y-%m') AS month, account, CAST(sum(amount) AS BIGINT) AS amount FROM (
 SELECT c.company_id, c.month, m.account, -m.amount AS amount FROM cv c JOIN mv m ON m.company_id = c.company_id AND m.fy_start = c.fy_start AND m.month <= c.month AND m.account BETWEEN 3000 AND 8999
 UNION ALL SELECT ed.company_id, ed.month, r.account, -r.amount FROM ed JOIN rs r ON r.company_id = ed.company_id AND r.fy_start = ed.fy_start AND r.account <= 8999
 UNION ALL SELECT ed.company_id, ed.month, 8999, (SELECT sum(amount) FROM ub u WHERE u.company_id = ed.company_id AND u.fy_start = ed.fy_start)
  + coalesce((SELECT sum(amount) FROM rs r WHERE r.company_id = ed.company_id AND r.fy_start = ed.fy_start AND r.account <= 8999), 0) FROM ed) GROUP BY ALL HAVING sum(amount) <> 0""",
        _MIX,
    ),
    "result_to_date": O.query(
        """SELECT c.company_id, strftime(c.month, '%Y-%m') AS month, m.account, CAST(-sum(m.amount) AS BIGINT) AS amount, CAST(e.closing AS INTEGER) AS closing_entries
 FROM cov c JOIN mm m ON m.company_id = c.company_id AND m.month BETWEEN c.fy_start AND c.month JOIN (VALUES (0, 8989), (1, 8999)) e(closing, upper) ON m.account BETWEEN 3000 AND e.upper GROUP BY ALL HAVING sum(m.amount) <> 0"""
    ),
}
