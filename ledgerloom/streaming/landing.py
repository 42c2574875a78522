"""Incremental landing: new voucher files are merged as they arrive, once each.

A file source feeds ``foreachBatch``. A batch appends what it changes to a log and rewrites nothing:
bodies of new and changed vouchers, opened and closed versions, and the differences it makes to the
monthly movements. Readers merge the log with the base tables (merge on read), and ``compact`` folds the
log into new base files of the fiscal years that it touched. So what a batch writes depends on the batch,
not on the tables.

Every batch has a log number. What a batch does is recorded first, under the stream's identity and the
batch's number, so a batch that is repeated after a failure gets the same log number, repeats the same
actions and ends in the same tables; a batch sees the tables as of its log number. Vouchers delivered
again are unchanged by their content hash. A new stream (a new checkpoint) goes on with each company's
next import sequence. One stream lands at a time, and a batch that failed is repeated before another one.

Layout under ``root``: ``runs`` and ``actions`` (by stream and batch), ``done`` (log numbers of complete
batches), ``log/<table>/lsn=<n>``, ``base/<table>/fy_start=<day>/base=<n>`` and ``manifest/v=<n>``, whose
latest version names the base that counts for each fiscal year: that of all log entries up to ``base``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import versions as V
from ledgerloom.operators.voucher_facts import full_content_hash
from ledgerloom.schema import ROW, VOUCHERS
from ledgerloom.session import stage

_KEY = [("company_id", T.StringType()), ("fy_start", T.DateType())]
_VERSION = [*_KEY, ("series", T.StringType()), ("number", T.StringType()), ("voucher_date", T.DateType()), ("content_hash", T.StringType()), ("valid_from", T.IntegerType()), ("valid_to", T.IntegerType())]
_MOVEMENT = [*_KEY, ("month", T.DateType()), ("account", T.IntegerType()), ("amount", T.LongType())]
RUN_SCHEMA = "company_id string, seq int, lsn bigint, stream string, batch bigint"
TABLES = {
    "versions": T.StructType([T.StructField(*c) for c in _VERSION]),
    "vouchers": VOUCHERS,
    "movements": T.StructType([T.StructField(*c) for c in _MOVEMENT]),
}


def _row_movements(vouchers: DataFrame, sign: int) -> DataFrame:
    """Signed amounts of the rows that count, by fiscal year, month and account."""
    rows = vouchers.select("company_id", "fy_start", F.trunc("voucher_date", "MM").alias("month"), F.explode("rows").alias("r")).where("r.status <> 'removed'")
    return rows.select("company_id", "fy_start", "month", F.col("r.account").alias("account"), (sign * F.col("r.amount")).alias("amount"))


def _summed(movements: DataFrame) -> DataFrame:
    return movements.groupBy("company_id", "fy_start", "month", "account").agg(F.sum("amount").alias("amount")).where("amount <> 0")


class Landing:
    """The landed tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # ---------------------------------------------------------------------------- stored files
    def _read(self, path: str, schema: str | T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def _folded(self) -> dict[dt.date, int]:
        """Log number up to which each fiscal year is in the base; one row per fiscal year."""
        kept = self._read("manifest", "fy_start date, base bigint, v bigint")
        last = kept.agg(F.max("v")).first()[0]
        return {r.fy_start: r.base for r in kept.where(F.col("v") == last).collect()} if last else {}

    def _base(self, name: str, folded: dict[dt.date, int]) -> DataFrame:
        """The base files that count; the conditions on both partition columns skip all others."""
        wanted = F.lit(False)
        for year, base in folded.items():
            wanted = wanted | ((F.col("fy_start") == F.lit(year)) & (F.col("base") == base))
        schema = TABLES[name]
        return self._read(f"base/{name}", T.StructType([*schema, T.StructField("base", T.LongType())])).where(wanted).select(*schema.fieldNames())

    def _log(self, name: str, folded: dict[dt.date, int], before: int | None) -> DataFrame:
        """Log entries that are not in the base, up to but without log number ``before``."""
        entries = self._read(f"log/{name}", T.StructType([*TABLES[name], T.StructField("lsn", T.LongType())]))
        known = F.create_map(*[F.lit(x) for pair in folded.items() for x in pair]) if folded else None
        after = F.coalesce(F.try_element_at(known, "fy_start"), F.lit(0)) if folded else F.lit(0)
        open_ = F.col("lsn") > after
        return entries.where(open_ if before is None else open_ & (F.col("lsn") < before))

    def _append(self, df: DataFrame, name: str, lsn: int) -> None:
        df.select(*TABLES[name].fieldNames()).write.mode("overwrite").parquet(f"{self.root}/log/{name}/lsn={lsn}")

    def _recorded(self, name: str, stream: str, batch_id: int, make) -> DataFrame:
        """What the batch wrote under ``name`` before, else what ``make`` gives now, written."""
        path = f"{self.root}/{name}/stream={stream}/batch={batch_id}"
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:
            make().write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)

    # --------------------------------------------------------------------------------- readers
    def versions(self, before: int | None = None) -> DataFrame:
        """Base and opened versions, closed by the log's closing entries."""
        folded = self._folded()
        entries = self._log("versions", folded, before)
        opened = entries.where("valid_to IS NULL").drop("lsn")
        closed = entries.where("valid_to IS NOT NULL").select(*V.KEY, "valid_from", F.col("valid_to").alias("closed"))
        both = self._base("versions", folded).unionByName(opened).join(closed, [*V.KEY, "valid_from"], "left")
        return both.withColumn("valid_to", F.coalesce("valid_to", "closed")).select(*V.COLUMNS)

    def vouchers(self, before: int | None = None) -> DataFrame:
        """The latest body of every voucher: that of the log, else that of the base."""
        folded = self._folded()
        names = VOUCHERS.fieldNames()
        body = F.struct(*[F.col(c) for c in names if c not in V.KEY])
        latest = self._log("vouchers", folded, before).groupBy(*V.KEY).agg(F.max_by(body, "lsn").alias("b")).select(*V.KEY, "b.*")
        rest = self._base("vouchers", folded).join(latest.select(*V.KEY), V.KEY, "left_anti")
        return rest.select(*names).unionByName(latest.select(*names))

    def _movements(self, before: int | None = None) -> DataFrame:
        folded = self._folded()
        return _summed(self._base("movements", folded).unionByName(self._log("movements", folded, before).drop("lsn")))

    def movements(self) -> DataFrame:
        """Net movement per company, month and account; zero nets dropped."""
        return self._movements().groupBy("company_id", "month", "account").agg(F.sum("amount").alias("amount")).where("amount <> 0")

    def runs(self) -> DataFrame:
        return self._read("runs", RUN_SCHEMA)

    # --------------------------------------------------------------------------------- writers
    def _sequences(self, batch: DataFrame) -> DataFrame:
        """The batch's log number and the next import sequence of each of its companies."""
        runs = self.runs()
        lsn = (runs.agg(F.max("lsn")).first()[0] or 0) + 1
        last = runs.groupBy("company_id").agg(F.max("seq").alias("last"))
        named = batch.select("company_id").distinct().join(last, "company_id", "left")
        return named.select("company_id", (F.coalesce("last", F.lit(0)) + 1).alias("seq"), F.lit(lsn).cast("long").alias("lsn"))

    def _actions(self, batch: DataFrame, sequences: DataFrame, before: int, in_years: Column) -> DataFrame:
        """What the batch does to the vouchers it holds; all others stay as they are."""
        keys = batch.select(*V.KEY).distinct()
        current = self.versions(before).where(in_years & F.col("valid_to").isNull()).join(keys, V.KEY, "left_semi")
        scope = batch.select("company_id", "fy_start").distinct().withColumns({"lo": F.lit(None).cast("date"), "hi": F.lit(None).cast("date")})
        return V.classify(current, batch, scope).join(sequences.drop("lsn"), "company_id")

    def merge(self, batch: DataFrame, batch_id: int, stream: str = "manual") -> None:
        """Adds and changes the vouchers of a batch; deliveries never remove."""
        hashed = batch.select(*self._typed(batch)).withColumn("content_hash", full_content_hash())
        batch = stage(hashed.withColumn("number", V.voucher_key()), "landing_batch")
        years = [r.fy_start for r in batch.select("fy_start").distinct().collect()]  # a few fiscal years
        if not years:
            return
        in_years = F.col("fy_start").isin(years)
        sequences = self._recorded("runs", stream, batch_id, lambda: self._sequences(batch))
        lsn = sequences.first().lsn
        if lsn <= max(self._folded().values(), default=0):
            return  # complete before, and in the base by now
        actions = self._recorded("actions", stream, batch_id, lambda: self._actions(batch, sequences, lsn, in_years))

        fresh = actions.where("action IN ('added', 'changed')").select(*V.KEY, F.col("new_hash").alias("content_hash"))
        rows = stage(batch.join(fresh, [*V.KEY, "content_hash"], "left_semi").dropDuplicates(V.KEY).drop("content_hash"), "landing_rows")
        self._append(rows, "vouchers", lsn)

        none, was_open = F.lit(None).cast("int"), actions.where("action = 'changed'")
        opened = actions.where("action IN ('added', 'changed')").select(*V.KEY, F.col("new_date").alias("voucher_date"), F.col("new_hash").alias("content_hash"), F.col("seq").alias("valid_from"), none.alias("valid_to"))
        closed = was_open.select(*V.KEY, F.col("old_date").alias("voucher_date"), F.col("old_hash").alias("content_hash"), "valid_from", F.col("seq").alias("valid_to"))
        self._append(opened.unionByName(closed), "versions", lsn)

        old = self.vouchers(lsn).where(in_years).join(was_open.select(*V.KEY), V.KEY, "left_semi")
        self._append(_summed(_row_movements(rows, 1).unionByName(_row_movements(old, -1))), "movements", lsn)
        self.spark.range(1).select(F.lit(lsn).alias("number")).write.mode("overwrite").parquet(f"{self.root}/done/lsn={lsn}")

    def _complete(self) -> int:
        """The log number up to which all batches are complete."""
        done = self._read("done", "lsn bigint")
        started = self.runs().select("lsn").distinct()
        pending = started.join(done.select("lsn"), "lsn", "left_anti").agg(F.min("lsn")).first()[0]
        return pending - 1 if pending else started.agg(F.max("lsn")).first()[0] or 0

    def compact(self) -> list[dt.date]:
        """Folds the log into the base of the fiscal years that it touched; returns those years.

        New base files lie beside the old ones until the manifest names them, so readers see either.
        """
        folded, last = self._folded(), self._complete()
        entries = self._log("versions", folded, last + 1)
        years = sorted(r.fy_start for r in entries.select("fy_start").distinct().collect())  # a few fiscal years
        if not years:
            return []
        for name, table in (("versions", self.versions(last + 1)), ("vouchers", self.vouchers(last + 1)), ("movements", self._movements(last + 1))):
            part = table.where(F.col("fy_start").isin(years)).withColumn("base", F.lit(last).cast("long"))
            laid = part.hint("rebalance", "fy_start").sortWithinPartitions("fy_start", "company_id")
            laid.write.partitionBy("fy_start", "base").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/base/{name}")
        version = (self._read("manifest", "fy_start date, base bigint, v bigint").agg(F.max("v")).first()[0] or 0) + 1
        now = [(year, base) for year, base in (folded | dict.fromkeys(years, last)).items()]
        self.spark.createDataFrame(now, "fy_start date, base bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        return years

    @staticmethod
    def _typed(batch: DataFrame) -> list:
        """The columns of the voucher table; row fields that a delivery lacks are null."""
        given = {f.name for f in batch.schema["rows"].dataType.elementType}
        field = lambda r, f: (r[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
        rows = F.transform("rows", lambda r: F.struct(*[field(r, f) for f in ROW])).alias("rows")
        return [*(F.col(f.name) for f in VOUCHERS if f.name != "rows"), rows]


def stream(spark: SparkSession, source: str, root: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Starts the landing stream over everything available, then stops (a scheduled run)."""
    landing = Landing(spark, root)
    return (
        spark.readStream.format("parquet")
        .schema(VOUCHERS)
        .option("maxFilesPerTrigger", max_files)
        .load(source)
        .writeStream.foreachBatch(lambda batch, n: landing.merge(batch, n, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
