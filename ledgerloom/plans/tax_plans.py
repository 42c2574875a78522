"""Registered queries: the tax account against the authority's statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import tax_account as T
from ledgerloom.plans import oracle as O
from ledgerloom.plans.book import Book
from ledgerloom.sources import demo


def _matched(book: Book) -> tuple[DataFrame, DataFrame]:
    """The statement and both sides' rows with their partners."""
    if "tax_matched" not in book.__dict__:
        booked = T.booked_rows(book.facts)
        statement = demo.tax_statement(booked)
        book.__dict__["tax_matched"] = statement, book.stage(T.reconcile(T.in_years(statement, book.fiscal_years), booked), "tax_matched")
    return book.__dict__["tax_matched"]


def tax_reconciliation(book: Book) -> DataFrame:
    """Rows of the tax account and of a statement derived from it: shifted dates, some rows lost, interest added."""
    _, matched = _matched(book)
    return matched.select("company_id", "side", F.col("date").cast("string").alias("date"), "amount", "id", "partner", F.col("partner_date").cast("string").alias("partner_date"))


def tax_account_status(book: Book) -> DataFrame:
    """Balances, difference and open rows of the tax account at every month end."""
    statement, matched = _matched(book)
    return T.status(matched, statement, book.balances, book.coverage).withColumn("month", F.date_format("month", "yyyy-MM"))


QUERIES = {f.__name__: f for f in (tax_reconciliation, tax_account_status)}

_MATCH = """bk AS (SELECT company_id, fy, vdate AS date, amount, series || '|' || number || '|' || rn AS id, CAST(split_part(number, '-', 1) AS BIGINT) AS ok, CAST(split_part(number, '-', 3) AS BIGINT) AS pk
 FROM p WHERE account BETWEEN 1630 AND 1639),
st0 AS (SELECT company_id, CAST(date + CAST(pk % 5 AS INTEGER) AS DATE) AS date, amount, id FROM bk WHERE ok % 7 <> 0
 UNION ALL SELECT company_id, CAST(date + 1 AS DATE), CAST(1500 AS BIGINT), id || '|R' FROM bk WHERE ok % 11 = 0),
st AS (SELECT s.*, f.fy_start AS fy FROM st0 s LEFT JOIN fy f ON f.company_id = s.company_id AND s.date BETWEEN f.fy_start AND f.fy_end),
bn AS (SELECT *, row_number() OVER (PARTITION BY company_id, fy, amount ORDER BY date, id) - 1 AS place FROM bk),
sc AS (SELECT s.company_id, s.fy, s.amount, s.date, s.id, count(*) FILTER (b.date < s.date - 3) AS a, count(*) FILTER (b.date <= s.date + 3) AS b
 FROM st s LEFT JOIN bk b ON b.company_id = s.company_id AND b.fy = s.fy AND b.amount = s.amount WHERE s.fy IS NOT NULL GROUP BY ALL),
sn AS (SELECT *, row_number() OVER (PARTITION BY company_id, fy, amount ORDER BY date, id) AS i FROM sc),
rec(company_id, fy, amount, i, p, place) AS (SELECT DISTINCT company_id, fy, amount, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM sn
 UNION ALL SELECT s.company_id, s.fy, s.amount, s.i, greatest(r.p, s.a) + CASE WHEN greatest(r.p, s.a) < s.b THEN 1 ELSE 0 END, CASE WHEN greatest(r.p, s.a) < s.b THEN greatest(r.p, s.a) END
 FROM rec r JOIN sn s ON s.company_id = r.company_id AND s.fy = r.fy AND s.amount = r.amount AND s.i = r.i + 1),
pr AS (SELECT s.company_id, s.fy, s.amount, s.date, s.id, b.date AS pdate, b.id AS pid FROM sn s JOIN rec r ON r.company_id = s.company_id AND r.fy = s.fy AND r.amount = s.amount AND r.i = s.i
 LEFT JOIN bn b ON b.company_id = s.company_id AND b.fy = s.fy AND b.amount = s.amount AND b.place = r.place),
mt AS (SELECT company_id, fy, 'statement' AS side, date, amount, id, pid AS partner, pdate AS partner_date FROM pr
 UNION ALL SELECT company_id, fy, 'statement', date, amount, id, NULL, NULL FROM st WHERE fy IS NULL
 UNION ALL SELECT b.company_id, b.fy, 'ledger', b.date, b.amount, b.id, q.id, q.date FROM bn b LEFT JOIN pr q ON q.company_id = b.company_id AND q.fy = b.fy AND q.amount = b.amount AND q.pid = b.id AND q.pdate = b.date)"""

SQL = {
    "tax_reconciliation": O.query("SELECT company_id, side, strftime(date, '%Y-%m-%d') AS date, amount, id, partner, strftime(partner_date, '%Y-%m-%d') AS partner_date FROM mt", _MATCH),
    "tax_account_status": O.query(
        """SELECT company_id, strftime(month, '%Y-%m') AS month, statement_balance, book_balance, book_balance - statement_balance AS difference, open_statement_n, open_statement_amount, open_ledger_n, open_ledger_amount FROM (
 SELECT c.company_id, c.month, CAST(coalesce((SELECT sum(s.amount) FROM st0 s WHERE s.company_id = c.company_id AND date_trunc('month', s.date) <= c.month), 0) AS BIGINT) AS statement_balance,
  CAST(coalesce((SELECT sum(b.balance) FROM bal b WHERE b.company_id = c.company_id AND b.month = c.month AND b.account BETWEEN 1630 AND 1639), 0) AS BIGINT) AS book_balance,
  count(*) FILTER (o.side = 'statement') AS open_statement_n, CAST(coalesce(sum(o.amount) FILTER (o.side = 'statement'), 0) AS BIGINT) AS open_statement_amount,
  count(*) FILTER (o.side = 'ledger') AS open_ledger_n, CAST(coalesce(sum(o.amount) FILTER (o.side = 'ledger'), 0) AS BIGINT) AS open_ledger_amount
 FROM cov c LEFT JOIN mt o ON o.company_id = c.company_id AND o.fy = c.fy_start AND date_trunc('month', o.date) <= c.month AND (o.partner IS NULL OR date_trunc('month', o.partner_date) > c.month)
 GROUP BY c.company_id, c.month)""",
        _MATCH,
    ),
}
