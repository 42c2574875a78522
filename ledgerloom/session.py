"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on. Sizes (executors, memory, shuffle partitions) stay with the
#: cluster; AQE coalesces and splits shuffle partitions at run time.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "ledgerloom", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Scratch folders of local sessions that name none, by application.
_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    A local session (tests, the benchmark) may leave it unset and gets a temporary folder; on a
    cluster a missing setting is an error, since executors do not share the driver's disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="ledgerloom-")
    return _LOCAL_SCRATCH[context.applicationId]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` once, so that all groupings, windows and joins that contain them need no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stage(df: DataFrame, name: str, even: bool = False, by: str | None = None, order: tuple[str, ...] = (), buckets: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where one intermediate table feeds many branches or an iteration: the written table
    survives lost executors, keeps column pruning and gives the planner real sizes. ``even`` lets
    AQE split and merge the output into even files, for tables that skewed joins feed. ``by``
    partitions the table by a column of few values, so that filters on it skip files; without
    ``even`` the rows stay with their tasks, which suits tables derived from one laid out alike.
    Within files rows are sorted by ``order``. ``buckets`` keeps a table that ``dealt`` laid out by these
    columns in that layout, as a bucketed table, so that its readers need no shuffle for them either.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    laid = df.hint("rebalance", *([by] if by else [])) if even else df
    if order:
        laid = laid.sortWithinPartitions(*([by] if by else []), *order)
    writer = laid.write.mode("errorifexists").option("compression", "zstd")
    if buckets:
        table = f"{name}_{uuid.uuid4().hex}"
        number = int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer.format("parquet").bucketBy(number, *buckets).option("path", path).saveAsTable(table)
        return spark.table(table).select(*df.columns)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
