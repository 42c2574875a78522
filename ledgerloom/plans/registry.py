"""All registered queries, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.book import open_book

MODULES = ("statement_plans", "control_plans", "explain_plans", "spend_plans", "review_plans", "text_plans", "ingest_plans", "landing_plans", "tax_plans", "source_plans")


def _modules():
    return [import_module(f"ledgerloom.plans.{m}") for m in MODULES]


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()[name](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        for name, fn in module.QUERIES.items():
            out[name] = lambda spark, sf_dir, fn=fn: fn(open_book(spark, sf_dir))
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out.update(module.SQL)
    return out
