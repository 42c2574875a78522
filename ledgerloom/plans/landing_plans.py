"""Registered queries over the landed tables: vouchers that arrive in several deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans import oracle as O
from ledgerloom.plans.book import Book


def landing_incremental(book: Book) -> DataFrame:
    """Monthly movements of the landed sales vouchers, kept up by differences; equal to those of the final vouchers."""
    return book.landing.movements().select("company_id", F.date_format("month", "yyyy-MM").alias("month"), "account", "amount")


def landing_versions(book: Book) -> DataFrame:
    """Versions that the deliveries opened and closed."""
    return book.landing.versions().select("company_id", "number", "valid_from", "valid_to")


def landing_vouchers(book: Book) -> DataFrame:
    """The landed bodies: date, text and row sums of every voucher."""
    total = F.aggregate("rows", F.lit(0).cast("bigint"), lambda s, r: s + F.abs(r["amount"]))
    return book.landing.vouchers().select("company_id", "number", F.col("voucher_date").cast("string").alias("voucher_date"), "text", F.size("rows").alias("n_rows"), total.alias("gross"))


QUERIES = {f.__name__: f for f in (landing_incremental, landing_versions, landing_vouchers)}

SQL = {
    "landing_incremental": O.query("SELECT company_id, strftime(month, '%Y-%m') AS month, account, CAST(sum(amount) AS BIGINT) AS amount FROM p WHERE series = 'B' GROUP BY 1, 2, 3 HAVING sum(amount) <> 0"),
    "landing_versions": O.query(
        """SELECT company_id, number, valid_from, valid_to FROM (
 SELECT company_id, number, CAST(1 AS INTEGER) AS valid_from, CASE WHEN moved THEN second END AS valid_to FROM d WHERE early
 UNION ALL SELECT company_id, number, second, NULL FROM d WHERE moved OR NOT early)""",
        """d AS (SELECT company_id, number, k % 20 <> 0 AS early, k % 20 <> 0 AND (k % 15 = 1 OR k % 31 = 5) AS moved, CAST(1 + max(CASE WHEN k % 20 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY company_id) AS INTEGER) AS second
 FROM (SELECT *, CAST(number AS BIGINT) AS k FROM v WHERE series = 'B'))""",
    ),
    "landing_vouchers": O.query(
        """SELECT v.company_id, number, strftime(vdate, '%Y-%m-%d') AS voucher_date, text, CAST(count(*) AS INTEGER) AS n_rows, CAST(sum(abs(amount)) AS BIGINT) AS gross
 FROM v JOIN r USING (vid) WHERE series = 'B' GROUP BY vid, v.company_id, number, vdate, text"""
    ),
}
