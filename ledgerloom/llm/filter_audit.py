"""Filter interaction audit by failing-id relations.

Every filter has a table of the ids of the rows that fail it, and every label one of the rows that carry
it. Left-semi and left-anti joins with these tables split the rows, one table after another, into those
that a filter would remove and those that survive it. A row survives a sequence of filters exactly if each
split left it on the anti side, and a filter removes it at its step if the split by that filter put it on
the semi side and those by all earlier filters on the anti side. So a row's sides name every prefix that it
survives, and no prefix needs a relation of its own: rows are counted by part and sides, and every order's
survivors, removals, redundant failures and label losses, and each filter's Shapley value, are sums over
these counts. Each split is a join on the row's own number, so no key is hot; the counts have at most
2 ** (filters + labels) rows a part.

Defined results: null texts are empty; a null lang is the part named by the empty string; documents with a
null doc_id carry no label, are not copies of a document and make no document a copy; rows with one doc_id
and one text are not copies of each other; a document labelled several times counts with each label it was
given; labels of unknown documents do nothing. Texts are compared by SHA-256. Extra columns are not read. Of
an empty table the result is empty.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage, table

#: Least words; least share of distinct words and largest share of capitals, in percent; characters that may not occur.
WORDS, DISTINCT, CAPITALS, ODD = 200, 50, 3, "#$%&*|"
#: Filters of the query in the order of their letters, and labels whose losses it reports.
FILTERS, LABELS = "ABCDE", {"good": "quality = 1", "toxic": "toxic = 1"}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that see one text: A few words, B repeated words, C capitals, D odd characters."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # one evaluation of the words for both counts
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("all"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))[0]
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return {
        "A": counts["all"] < WORDS,
        "B": 100 * counts["distinct"] < DISTINCT * counts["all"],
        "C": 100 * capitals.cast("long") > CAPITALS * F.length(text).cast("long"),
        "D": text.rlike("[" + "".join("\\" + c for c in ODD) + "]"),
    }


def copies(rows: DataFrame) -> DataFrame:
    """Rows (row) whose text is that of a smaller doc_id; ``rows``: row, doc_id, key."""
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    return rows.join(stage(first, "audit-firsts"), "key").where("doc_id > first").select("row")


def split(rows: DataFrame, ids: DataFrame, bit: int) -> DataFrame:
    """``rows`` (row, part, sides) after the split by one id table: ``bit`` is set in the sides of those in it."""
    there = rows.join(ids, "row", "left_semi").withColumn("sides", F.col("sides").bitwiseOR(F.lit(1 << bit)))
    return stage(there.unionByName(rows.join(ids, "row", "left_anti")), "audit-sides")


def sides(rows: DataFrame, failing: dict[str, DataFrame], labels: dict[str, DataFrame]) -> DataFrame:
    """(part, fails, <label>..., n): rows by part, filters they fail (bits in the order of ``failing``) and labels.

    ``rows``: row, part, each row once. ``failing`` and ``labels`` hold id tables (row, each once or more often).
    """
    now = rows.select("row", "part", F.lit(0).alias("sides"))
    tables = [*failing.values(), *labels.values()]
    for bit, ids in enumerate(tables):
        now = split(now, ids, bit)
    counts = now.groupBy("part", "sides").agg(F.count("*").alias("n"))
    fails = F.col("sides").bitwiseAND((1 << len(failing)) - 1).alias("fails")
    carried = [(F.col("sides").bitwiseAND(1 << (len(failing) + k)) != 0).alias(name) for k, name in enumerate(labels)]
    return counts.select("part", fails, *carried, "n")


def report(cells: DataFrame, names: str, labels: list[str]) -> DataFrame:
    """Every order's steps from the counts of ``sides``; columns as the module says, <label>_lost for each label.

    Each filter is seen after each set of others once; the orders then look their steps up.
    """
    spark, n = cells.sparkSession, len(names)
    meets = [(before, k) for k in range(n) for before in range(1 << n) if not before >> k & 1]
    seen = cells.withColumn("meet", F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(k).alias("filter")) for b, k in meets])))
    own = F.expr("shiftleft(1, meet.filter)")
    failing, passed = F.col("fails").bitwiseAND(own) != 0, F.col("fails").bitwiseAND(F.col("meet.before")) == 0
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).alias
    steps = seen.groupBy("part", "meet.before", "meet.filter").agg(
        total(~failing & passed)("kept"),
        total(failing & passed)("removed"),
        total(failing & ~passed)("redundant"),
        total(F.col("fails") == own)("unique_fails"),
        *[total(failing & passed & F.col(name))(f"{name}_lost") for name in labels],
    )
    steps = stage(steps, "audit-steps")
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    worth = steps.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    orders = [("".join(names[k] for k in order), step + 1, sum(1 << k for k in order[:step]), order[step]) for order in itertools.permutations(range(n)) for step in range(n)]
    orders = spark.createDataFrame(orders, "filter_order string, step int, before int, filter int")
    lost = [f"{name}_lost" for name in labels]
    return steps.join(orders, ["before", "filter"]).join(worth, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


def audit(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The audit of ``documents`` by the five filters; ``marks``: doc_id, quality, toxic."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    seen = stage(own.select("row", "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), *[c.alias(f"fails_{f}") for f, c in text_failures(F.col("text")).items()]), "audit-rows")
    failing = {f: seen.where(f"fails_{f}").select("row") for f in FILTERS[:-1]} | {FILTERS[-1]: copies(seen)}
    failing = {f: stage(ids, f"audit-{f}") for f, ids in failing.items()}
    labels = {name: stage(seen.join(marks.where(test).select("doc_id"), "doc_id", "left_semi").select("row"), f"audit-{name}") for name, test in LABELS.items()}
    return report(sides(seen, failing, labels), FILTERS, list(LABELS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = f"""
WITH d AS MATERIALIZED (
       SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
              coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
       FROM documents),
     f AS MATERIALIZED (
       SELECT part, [len(w) < {WORDS}, 100 * len(list_distinct(w)) < {DISTINCT} * len(w),
                     100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {CAPITALS} * length(t), regexp_matches(t, '[#$%&*|]'), e] AS fails,
              doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
              doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS bad
       FROM d),
     c AS MATERIALIZED (SELECT part, fails, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n FROM f GROUP BY ALL),
     k AS (SELECT unnest(range(1, {len(FILTERS) + 1})) AS i),
     o AS (SELECT [{", ".join(f"k{j}.i" for j in range(1, 6))}] AS p FROM {", ".join(f"k k{j}" for j in range(1, 6))}),
     s AS MATERIALIZED (SELECT array_to_string(list_transform(p, lambda x: substr('{FILTERS}', x, 1)), '') AS filter_order, CAST(j AS INTEGER) AS step, p[1:j - 1] AS before, p[j] AS own
           FROM o, (SELECT unnest(range(1, 6)) AS j) WHERE len(list_distinct(p)) = 5),
     r AS (SELECT part, filter_order, step, own, fails, good, bad, n, fails[own] AS bites, len(list_filter(before, lambda x: fails[x])) > 0 AS gone FROM c, s),
     a AS (SELECT part, filter_order, step, own,
                  CAST(sum(CASE WHEN NOT bites AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN bites AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
                  CAST(sum(CASE WHEN bites AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
                  CAST(sum(CASE WHEN bites AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                  CAST(sum(CASE WHEN bites AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN bites AND NOT gone AND bad THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
           FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""
