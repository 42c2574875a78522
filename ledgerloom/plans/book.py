"""The shared tables of one run: written once to the shared folder, read by every plan.

In production these are the stored ledger tables; here they are derived from the trade tables the
first time a plan asks for them.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import findings as FI
from ledgerloom.operators import ledger as L
from ledgerloom.operators import maturity as U
from ledgerloom.operators import metrics as M
from ledgerloom.operators import periods as P
from ledgerloom.operators import spend as E
from ledgerloom.operators import statements as S
from ledgerloom.operators import versions as V
from ledgerloom.operators.controls.base import LazyContext, run
from ledgerloom.operators.voucher_facts import spelled_out, stored_facts
from ledgerloom.session import JOB_CONF, scratch_dir, stage
from ledgerloom.sources import demo
from ledgerloom.streaming import landing
from ledgerloom.streaming.landing import Landing

_BOOKS: dict[tuple[str, str], Book] = {}


def open_book(spark: SparkSession, sf_dir: str) -> Book:
    """The book of a folder, shared by all plans of the same Spark application."""
    for key, value in JOB_CONF.items():
        if not key.startswith("spark.sql.adaptive"):
            spark.conf.set(key, value)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BOOKS:
        _BOOKS[key] = Book(spark, sf_dir)
    return _BOOKS[key]


class Book:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @staticmethod
    def stage(df: DataFrame, name: str) -> DataFrame:
        return stage(df, name)

    def _has(self, table: str) -> bool:
        """Whether a shared table is written already."""
        return table in self.__dict__

    @cached_property
    def vouchers(self) -> DataFrame:
        """The nested vouchers by fiscal year, written by the tasks that derive them: no shuffle only for the layout."""
        return stage(demo.vouchers(self.spark, self.sf_dir), "vouchers", by="fy_start", order=("company_id", "voucher_date"))

    @property
    def passing_vouchers(self) -> DataFrame:
        """The vouchers for a reader that goes over them once: not written for it alone."""
        return self.vouchers if self._has("vouchers") else demo.vouchers(self.spark, self.sf_dir)

    @cached_property
    def sales(self) -> DataFrame:
        """The vouchers of series B, which imports and deliveries are made of."""
        return self.vouchers.where("series = 'B'") if self._has("vouchers") else stage(demo.sales(self.spark, self.sf_dir), "sales")

    @cached_property
    def movements(self) -> DataFrame:
        """Summed from the vouchers or facts if these are written already, else from the trade tables: sums need no texts."""
        if self._has("vouchers"):
            source = self.vouchers
        elif self._has("facts"):
            rows = F.transform("eff", lambda r: F.struct(r["account"].alias("account"), r["amount"].alias("amount"), F.lit("normal").alias("status")))
            source = self.facts.select("company_id", "voucher_date", rows.alias("rows"))
        else:
            source = demo.vouchers(self.spark, self.sf_dir, text=False)
        return stage(L.monthly_movements(source), "movements")

    @cached_property
    def companies(self) -> DataFrame:
        return demo.companies(self.spark, self.sf_dir)

    @cached_property
    def accounts(self) -> DataFrame:
        return demo.accounts(self.spark, self.sf_dir)

    @cached_property
    def aliases(self) -> DataFrame:
        return demo.aliases(self.spark, self.sf_dir)

    @cached_property
    def fiscal_years(self) -> DataFrame:
        return stage(demo.fiscal_years(self.movements), "fiscal_years")

    @cached_property
    def year_balances(self) -> DataFrame:
        return stage(demo.year_balances(self.movements, self.fiscal_years), "year_balances")

    @cached_property
    def budget(self) -> DataFrame:
        return demo.budget(self.movements)

    @cached_property
    def coverage(self) -> DataFrame:
        return stage(L.month_coverage(self.fiscal_years), "coverage")

    @cached_property
    def basis(self) -> DataFrame:
        return stage(L.opening_basis(self.fiscal_years, self.year_balances), "basis")

    @cached_property
    def openings(self) -> DataFrame:
        return stage(L.opening_balances(self.movements, self.basis, self.year_balances), "openings")

    @cached_property
    def balances(self) -> DataFrame:
        return stage(L.balances(self.movements, self.coverage, self.openings), "balances")

    @cached_property
    def complete(self) -> DataFrame:
        return L.balance_complete(self.coverage, self.basis)

    @cached_property
    def monthly(self) -> DataFrame:
        return stage(S.monthly_lines(self.movements), "monthly_lines")

    @cached_property
    def balance_wide(self) -> DataFrame:
        return stage(S.balance_wide(self.monthly, self.coverage, self.openings, self.complete), "balance_wide")

    @cached_property
    def facts(self) -> DataFrame:
        """Facts per voucher; the vouchers themselves are not written for them."""
        return spelled_out(stage(stored_facts(self.passing_vouchers), "facts"))

    @cached_property
    def text_spend(self) -> DataFrame:
        return stage(E.text_spend(self.vouchers), "text_spend")

    @cached_property
    def spend(self) -> DataFrame:
        return stage(E.spend_months(self.text_spend, self.aliases), "spend")

    @cached_property
    def quarter_spend(self) -> DataFrame:
        """Spend rows of quarters against the year before."""
        return stage(E.spend_rows(self.year_pairs("quarter"), self.spend, self.coverage), "quarter_spend")

    @cached_property
    def month_spend(self) -> DataFrame:
        """Spend rows of months against the month before."""
        return stage(E.spend_rows(self.month_pairs(), self.spend, self.coverage), "month_spend")

    @cached_property
    def maturity(self) -> DataFrame:
        return stage(U.maturity(self.facts, self.movements, self.coverage, self.balances), "maturity")

    @cached_property
    def context(self) -> LazyContext:
        return LazyContext(self)

    @cached_property
    def versions(self) -> list[DataFrame]:
        """Version table after each of the three imports, and the actions of each."""
        empty = self.spark.createDataFrame([], "company_id string, fy_start date, series string, number string, voucher_date date, content_hash string, valid_from int, valid_to int")
        tables, self.actions = [empty], []
        for seq, (incoming, scope) in enumerate(zip(demo.imports(self.sales), demo.import_scopes(self.fiscal_years), strict=True), 1):
            acts = stage(V.classify(tables[-1], incoming, scope), "import_actions")
            self.actions.append(acts)
            tables.append(stage(V.merge(tables[-1], acts, scope, seq), "voucher_versions"))
        return tables

    @cached_property
    def landing(self) -> Landing:
        """Sales vouchers landed in three deliveries, with the log folded into the base after the first."""
        home = f"{scratch_dir(self.spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
        landed = Landing(self.spark, f"{home}/tables")
        for n, delivery in enumerate(demo.deliveries(self.sales)):
            delivery.select(*Landing._typed(delivery)).write.parquet(f"{home}/arrived/delivery={n}")
            landing.stream(self.spark, f"{home}/arrived/delivery=*", landed.root, f"{home}/progress", max_files=1_000_000).awaitTermination()
            if n == 0:
                landed.compact()
        return landed

    @cached_property
    def candidates(self) -> DataFrame:
        """Findings of all controls, the input of the lifecycle plans."""
        return stage(run(LazyContext(self, self.changed)), "candidates", buckets=("company_id", "fingerprint"))

    @cached_property
    def approved(self) -> DataFrame:
        """Months approved before the last import."""
        return self.coverage.where("covered AND month <= DATE'2025-12-01' AND CAST(company_id AS INT) % 2 = 0").select("company_id", "month")

    @cached_property
    def changed(self) -> DataFrame:
        """What the last import changed in approved months."""
        return V.changed_months(V.changes(self.versions[3], 2, 3, self.approved))

    @cached_property
    def records(self) -> DataFrame:
        reviewed = self.coverage.where("covered AND month >= DATE'2024-01-01'").select("company_id", F.date_format("month", "yyyy-MM").alias("review"))
        return stage(
            FI.reconcile(demo.records(self.candidates), demo.rerun(self.candidates), reviewed, demo.suppressions(self.spark)), "records"
        )

    # ------------------------------------------------------------------------------- periods
    def periods(self, *kinds: str) -> DataFrame:
        return P.standard_periods(self.coverage, kinds)

    def year_pairs(self, *kinds: str) -> DataFrame:
        return P.same_period_previous_year(self.periods(*kinds), self.fiscal_years)

    def month_pairs(self) -> DataFrame:
        return P.previous_period(self.periods("month"))

    def income_both(self, pairs: DataFrame) -> DataFrame:
        """Income wide rows of both sides of the pairs."""
        ids = ["company_id", "kind", "period", "start", "end", "n_months"]
        both = pairs.select(*ids).unionByName(P.compare_side(pairs)).distinct()
        return S.income_wide(both, self.monthly, self.coverage)

    def figure_base(self, income: DataFrame) -> DataFrame:
        return M.figure_base(income, self.balance_wide, M.account_group_balances(self.balances))
