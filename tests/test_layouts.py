"""Tables that are dealt out once: what follows reads them without another shuffle, with the same rows."""

from __future__ import annotations

import datetime as dt
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import findings as FI
from ledgerloom.operators.controls import pattern
from ledgerloom.operators.voucher_facts import voucher_facts
from ledgerloom.session import dealt, stage
from ledgerloom.sources import demo
from tests.test_algorithms import SCHEMA, D, _v

FINDINGS = (
    "company_id string, review string, rule_code string, category string, severity string, visibility string, period string, key string, "
    "fingerprint string, vouchers array<string>, accounts array<int>, amount bigint, variant string"
)


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _shuffled(df) -> list[str]:
    """Keys of all shuffles of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)]


def _findings(spark, n=60):
    rows = [(str(i % 3), f"2025-0{1 + i % 4}", "INPUT_VAT_RATIO" if i % 2 else "LATE_BOOKING", "vat", "LOW", "INTERNAL", "2025-01", f"k{i // 2}", f"{i // 2 * 7919 % 65536:04x}", [f"A{i}"], [6310] if i % 4 == 1 else [1930], i, "") for i in range(n)]
    return spark.createDataFrame(rows, FINDINGS)


def test_records_shuffle_no_finding_again(spark, no_broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")  # the few mute rules, no findings
    found = _findings(spark)
    laid = stage(dealt(found, "company_id", "fingerprint"), "found", buckets=("company_id", "fingerprint"))
    reviewed = found.select("company_id", "review").distinct()
    whole = lambda df: FI.reconcile(demo.records(df), demo.rerun(df), reviewed, demo.suppressions(spark))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(whole(laid)) == rows(whole(found)) and whole(laid).where("status = 'SUPPRESSED'").count() > 0
    assert not [keys for keys in _shuffled(whole(laid)) if "fingerprint" in keys]


def test_copies_are_shuffled_once(spark, no_broadcast):
    day = lambda n: D(2026, 1, 1) + dt.timedelta(days=n)
    given = [_v(n, day(d), [(6110, 150_000), (1930, -150_000)], "Hyra") for n, d in enumerate((0, 0, 10, 30, 44, 59), 1)]
    found = pattern.exact_duplicates(voucher_facts(spark.createDataFrame(given, SCHEMA)), 100_000, 14)
    got = {(r.voucher, r.original, r.days_apart, r.n_pairs) for r in found.where("account = 6110").collect()}
    assert got == {("A2", "A1", 0, 1), ("A3", "A1", 10, 2), ("A5", "A4", 14, 1)}
    assert not _shuffled(found)


def test_similar_texts_meet_across_the_ends_of_date_buckets(spark, no_broadcast):
    texts = ["kontorshyra lokal a januari", "lokal kontorshyra a februari", "kontorshyra lokal ab januari"]
    given = [_v(n, D(2026, 1, 1) + dt.timedelta(days=n * 5), [(6110, 150_000), (1930, -150_000)], texts[n % 3]) for n in range(1, 40)]
    groups = [(v[4], v[6], v[2] + v[3]) for v in given]
    alike = lambda a, b: a[1] != b[1] and a[0] < b[0] and (b[0] - a[0]).days <= 14 and SequenceMatcher(None, a[1], b[1]).ratio() >= 0.8
    want = {(a[2], b[2]) for a in groups for b in groups if alike(a, b)}
    facts = voucher_facts(spark.createDataFrame(given, SCHEMA))
    listed = [(r.original, r.voucher) for r in pattern.similar_links(facts, 100_000, 14, 0.8).where("account = 6110").collect()]
    assert want and sorted(listed) == sorted(want)
    counted = pattern.similar_classes(facts, 100_000, 14, 0.8)
    assert {r.voucher: r.n_links for r in counted.where("account = 6110").collect()} == {v: sum(b == v for _, b in want) for v in {b for _, b in want}}
    assert not [keys for keys in _shuffled(counted) if keys.endswith("day_bucket") or "begin" in keys]


def test_staged_tables_keep_rows_and_columns(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("x"))
    laid = stage(dealt(df, "k"), "t", buckets=("k",))
    assert laid.columns == df.columns and sorted(laid.collect()) == sorted(df.collect())
    assert not _shuffled(laid.groupBy("k", "x").count())
