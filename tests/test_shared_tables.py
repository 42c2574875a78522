"""The shared tables of a run: what a plan does not read is not built, and sums do not depend on the source."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ranges as R
from ledgerloom.operators import ledger as L
from ledgerloom.operators.controls import base, pattern  # noqa: F401
from ledgerloom.operators.voucher_facts import spelled_out, stored_facts, voucher_facts
from ledgerloom.plans.book import Book
from ledgerloom.sources import demo

TYPES = ("STANDARD", "ECONOMY", "PROMO", "LARGE", "MEDIUM", "SMALL")


@pytest.fixture()
def folder(spark, tmp_path):
    """Trade tables of 60 orders with two lines each."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("nation", [(n, f"N{n}") for n in range(4)], "n_nationkey int, n_name string")
    put("customer", [(c, f"Kund {c}", c % 4) for c in range(8)], "c_custkey long, c_name string, c_nationkey int")
    put("part", [(p, f"del {p}", f"Brand#{p % 9}", TYPES[p % 6]) for p in range(120)], "p_partkey long, p_name string, p_brand string, p_type string")
    day = lambda o: f"{1996 + o % 3}-{1 + o % 12:02d}-{1 + o % 28:02d}"
    orders = spark.createDataFrame([(o, o % 8, "FO"[o % 2], 100.0 + o, day(o)) for o in range(60)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string")
    orders.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(o, n, (o * 2 + n) % 120, o % 31, "RN"[o % 2], 5000.0 + o * n, day(o + n)) for o in range(60) for n in range(2)]
    table = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_extendedprice double, l_shipdate string")
    table.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sums_need_no_stored_vouchers(spark, folder):
    """Movements are the same from the trade tables, the facts and the vouchers, and write neither of these."""
    raw, facts, whole = Book(spark, folder), Book(spark, folder), Book(spark, folder)
    alone = _rows(raw.movements)
    assert "vouchers" not in raw.__dict__ and "facts" not in raw.__dict__
    facts.facts.count()
    assert "vouchers" not in facts.__dict__
    whole.vouchers.count()
    assert alone and alone == _rows(facts.movements) == _rows(whole.movements)


def test_controls_build_only_what_they_read(spark, folder):
    """The trend control reads months only."""
    book = Book(spark, folder)
    base.gate(base.REGISTRY["REVENUE_COST_TREND"](book.context), book.context).count()
    assert "facts" not in book.__dict__ and "vouchers" not in book.__dict__ and "movements" in book.__dict__


def test_imports_need_no_order_lines(spark, folder):
    book = Book(spark, folder)
    assert _rows(book.sales.select("company_id", "number", "text")) == _rows(demo.vouchers(spark, folder).where("series = 'B'").select("company_id", "number", "text"))
    assert "vouchers" not in book.__dict__


def test_stored_facts_leave_out_what_can_be_derived(spark, folder):
    vouchers = demo.vouchers(spark, folder)
    stored = stored_facts(vouchers)
    assert not {"voucher", "month", "sig_hash", "neg_hash"} & set(stored.columns)
    spelled = lambda df: _rows(df.select("voucher", "month", "sig_hash", "neg_hash", F.col("eff").cast("string")))
    assert spelled(spelled_out(stored)) == spelled(voucher_facts(vouchers))


def test_line_lookup_is_the_ladder(spark):
    a = F.col("a")
    accounts = spark.range(-5, 10_050).select(F.col("id").cast("int").alias("a")).unionByName(spark.sql("SELECT CAST(NULL AS INT) AS a"))
    assert accounts.where(~R.line_lookup(a).eqNullSafe(R.statement_line(a))).count() == 0


def test_repeated_orders_multiply_their_lines(spark, folder):
    """Repeated order rows multiply their lines, in whatever order the tables are joined."""
    twice = spark.read.parquet(f"{folder}/orders.parquet").where("o_orderkey < 2")
    before = L.postings(demo.purchase_vouchers(spark, folder)).count()
    twice.write.mode("append").parquet(f"{folder}/orders.parquet")
    extra = L.postings(demo.purchase_vouchers(spark, folder).where("split(number, '-')[0] IN ('0', '1')")).count()
    assert L.postings(demo.purchase_vouchers(spark, folder)).count() == before + extra // 2
