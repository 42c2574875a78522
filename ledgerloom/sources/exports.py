"""Table exports: statements, findings, transactions and restricted signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.standard import amount_text

FORMATS = ("csv", "parquet", "json")


def flatten(df: DataFrame) -> DataFrame:
    """Arrays as comma lists, amounts in kronor: a flat table any sink can hold."""
    cols = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind.startswith("array<struct"):
            cols.append(F.to_json(field.name).alias(field.name))
        elif kind.startswith("array"):
            cols.append(F.array_join(F.transform(field.name, lambda x: x.cast("string")), ",").alias(field.name))
        elif kind == "bigint" and field.name in ("amount", "balance", "compare_amount", "diff", "effect", "budget", "actual"):
            cols.append(amount_text(F.col(field.name)).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def export(df: DataFrame, path: str, fmt: str = "csv", partition: list[str] | None = None, delimiter: str = ";") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = flatten(df).write.mode("errorifexists")
    if partition:
        writer = writer.partitionBy(*partition)
    if fmt == "csv":
        writer.option("header", "true").option("sep", delimiter).csv(path)
    else:
        writer.format(fmt).save(path)


def export_aml(findings: DataFrame, path: str) -> None:
    """Restricted signals only, as a semicolon table."""
    export(findings.where("visibility = 'RESTRICTED_AML'"), path, "csv")
