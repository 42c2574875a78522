"""Reversible masking of personal numbers, e-mail, mobile numbers and known names in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a personal number, an e-mail address and a Swedish mobile number.
PNR = r"\b(?:19|20)?(\d{6})[-+]?(\d{4})\b"
EMAIL = r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
PHONE = r"(?<!\d)(?:\+46[\s-]?|0)7[02369](?:[\s-]?\d){7}(?!\d)"


def _mask_kind(df: DataFrame, text: str, kind: str, pattern: Column, checked: bool) -> DataFrame:
    """Replace the matches of one kind by ``KIND_n``, n = order of first occurrence in the text.

    The text is cut at the matches and put together again, so only matched positions change.
    """
    found = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    if checked:
        keep = F.filter("_all", lambda m: F.call_function("luhn_check", F.substring(F.regexp_replace(m, r"\D", ""), -10, 10)))
    else:
        keep = F.col("_all")
    pieces = F.split(F.col(text), pattern, -1)

    def token(m: Column) -> Column:
        pos = F.array_position("_hits", m)
        return F.when(pos > 0, F.concat(F.lit(kind + "_"), pos.cast("string"))).otherwise(m)

    rebuilt = F.array_join(
        F.zip_with("_pieces", F.concat(F.transform("_all", token), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    out = df.withColumn("_all", found).withColumn("_hits", F.array_distinct(keep)).withColumn("_pieces", pieces)
    pairs = F.transform("_hits", lambda v, i: F.struct(F.concat(F.lit(kind + "_"), (i + 1).cast("string")).alias("token"), v.alias("value")))
    out = out.withColumn("_map", F.concat(F.col("_map"), pairs)).withColumn(
        text, F.when(F.size("_all") > 0, rebuilt).otherwise(F.col(text))
    )
    return out.drop("_all", "_hits", "_pieces")


#: Shorter names mask nothing; they would hit words.
SHORTEST_NAME = 3


def mask(df: DataFrame, text: str, names: str | None = None) -> DataFrame:
    """Adds ``masked`` and ``mapping`` (token, value) to every row.

    ``names``: a column with the row's known names, e.g. those of its company; longer names go first.
    """
    out = df.withColumn("masked", F.coalesce(F.col(text), F.lit(""))).withColumn(
        "_map", F.expr("CAST(array() AS array<struct<token:string,value:string>>)")
    )
    out = _mask_kind(out, "masked", "PNR", F.lit("(?U)" + PNR), True)
    out = _mask_kind(out, "masked", "EMAIL", F.lit("(?U)" + EMAIL), False)
    out = _mask_kind(out, "masked", "TEL", F.lit(PHONE), False)
    if names:
        usable = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: F.length(n) >= SHORTEST_NAME)
        longest = F.reverse(F.array_sort(F.transform(F.array_distinct(usable), lambda n: F.struct(F.length(n).alias("n"), n.alias("name")))))
        quoted = F.transform(longest, lambda n: F.concat(F.lit(r"\Q"), F.replace(n["name"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
        some = F.size(usable) > 0  # of null names the size is -1
        pattern = F.when(some, F.concat(F.lit(r"(?iU)\b(?:"), F.array_join(quoted, "|"), F.lit(r")\b"))).otherwise(F.lit(r"(?!)"))
        out = _mask_kind(out, "masked", "PERSON", pattern, False)
    return out.withColumnRenamed("_map", "mapping")


def unmask(masked: Column, mapping: Column) -> Column:
    """The text with its tokens replaced back, longest token first."""
    ordered = F.reverse(F.array_sort(F.transform(mapping, lambda m: F.struct(F.length(m["token"]).alias("n"), m["token"].alias("token"), m["value"].alias("value")))))
    return F.aggregate(ordered, masked, lambda acc, m: F.replace(acc, m["token"], m["value"]))
