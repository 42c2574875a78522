"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A rule (action, host, path) fits its host and all subdomains if the URL's path starts with the rule's
path; the longest rule that fits decides. Other URLs are judged by a logistic regression over the
character n-grams of host and path, hashed into ``BUCKETS`` weights. It is trained on the driver from
the small labelled table ``LABELLED``; scoring is one projection of built-in functions, without a shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by the intercept alone; repeated rows are judged alike. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Lengths of n-grams; hashed weights; training.
GRAMS = (3, 4)
BUCKETS = 2048
EPOCHS, RATE, DECAY = 150, 0.1, 1e-3

#: The labelled table: (url, block).
LABELLED = (
    ("http://cheap-pills.example.com/en/17", 1),
    ("https://www.cheap-pills.example.org/order?id=3", 1),
    ("http://best-pills.example.com/buy-now/", 1),
    ("https://pills-online.example.net/cheap/", 1),
    ("https://casino-win.example.com/es/4.html", 1),
    ("http://blog.casino-win.example.org/bonus", 1),
    ("http://royal-casino.example.com/jackpot/1", 1),
    ("https://casino-spins.example.net/win/", 1),
    ("http://free-bets.example.org/en/9/", 1),
    ("https://m.free-bets.example.com/today", 1),
    ("http://sport-bets.example.com/odds", 1),
    ("http://adult-x.example.com/en/2", 1),
    ("https://www.adult-x.example.org/de/8#top", 1),
    ("http://adult-cams.example.com/live/", 1),
    ("https://xxx-adult.example.net/fr/44", 1),
    ("http://spam-farm.example.org/en/728", 1),
    ("https://m.spam-farm.example.com/fr/3.html", 1),
    ("http://link-farm.example.com/seo/99", 1),
    ("http://ads-track.example.com/pixel?u=1", 1),
    ("https://www.ads-track.example.org/en/5", 1),
    ("http://click-ads.example.com/track/7", 1),
    ("http://track-ads.example.net/banner/2", 1),
    ("http://win-money.example.com/fast/cash", 1),
    ("https://payday-loans.example.com/cheap/1", 1),
    ("http://www.example.com/en/148.html", 0),
    ("https://blog.example.org/fr/96", 0),
    ("https://m.example.com/en/25#top", 0),
    ("https://news.example.com/world/2024/05/report", 0),
    ("http://library.example.org/de/453/", 0),
    ("https://docs.example.com/guide/intro.html", 0),
    ("https://www.university.example.org/research/history", 0),
    ("http://wiki.example.org/es/978?page=2", 0),
    ("https://museum.example.com/fr/collection/12", 0),
    ("http://weather.example.net/en/today", 0),
    ("https://city-council.example.org/en/minutes/3", 0),
    ("https://garden-notes.example.com/en/roses", 0),
    ("http://open-data.example.org/tables/7.html", 0),
    ("https://thorer.example.com/en/853/", 0),
    ("https://www.tiontion.example.com/en/474.html", 0),
    ("http://blog.thther.example.org/en/671?utm_source=feed", 0),
    ("http://m.ererin.example.com/fr/825?page=2", 0),
    ("https://thanand.example.org/es/797#top", 0),
    ("https://www.ingstor.example.com/de/612", 0),
    ("http://theated.example.net/en/369", 0),
    ("https://m.lyesble.example.org/fr/65.html", 0),
    ("https://blog.ththsh.example.com/es/2", 0),
    ("http://ndering.example.com/de/88?utm_source=feed", 0),
    ("http://recipes.example.com/soup/en/31", 0),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str) -> tuple[str, str]:
    """Host and path of a labelled URL, as the expressions below give them."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    host = min((rest.split(c)[0] for c in "/?#"), key=len)
    return host.translate(str.maketrans(_UPPER, _LOWER)), min((rest[len(host) :].split(c)[0] for c in "?#"), key=len)


def buckets(host: str, path: str, count: int = BUCKETS, grams: Sequence[int] = GRAMS) -> list[int]:
    out = []
    for kind, text in (("h", host), ("p", path)):
        for n in grams:
            out += [int(hashlib.md5((kind + text[i : i + n]).encode()).hexdigest()[:6], 16) % count for i in range(len(text) - n + 1)]
    return out


def train(labelled: Sequence[tuple[str, int]] = LABELLED, count: int = BUCKETS, grams: Sequence[int] = GRAMS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> tuple[float, list[float]]:
    """Intercept and weights, by stochastic gradient descent over the labelled table."""
    rows = [(buckets(*parts(url), count, grams), block) for url, block in labelled]
    intercept, weights = 0.0, [0.0] * count
    for _ in range(epochs):
        for found, block in rows:
            z = intercept + sum(weights[b] for b in found)
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - block
            intercept -= rate * error
            for b in found:
                weights[b] -= rate * (error + decay * weights[b]) / len(found) ** 0.5
    return round(intercept, 6), [round(w, 6) for w in weights]


@functools.cache
def trained() -> tuple[float, tuple[float, ...]]:
    intercept, weights = train()
    return intercept, tuple(weights)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text and as its action; nulls if none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, action = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def _gram_weight(weights: Column, kind: str, text: Column, n: int, count: int):
    """The weight of the n-gram at a place of ``text``, as a function of the running sum and the place."""

    def add(z: Column, at: Column) -> Column:
        digest = F.md5(F.concat(F.lit(kind), F.substring(text, at, F.lit(n))).cast("binary"))
        return z + F.element_at(weights, F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % count + 1)

    return add


def logit(host: Column, path: Column, intercept: float, weights: Sequence[float], grams: Sequence[int] = GRAMS) -> Column:
    """Intercept plus the weights of all n-grams of host and path."""
    total, known = F.lit(float(intercept)), F.lit(list(weights))
    for kind, text in (("h", host), ("p", path)):
        for n in grams:
            places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
            total = F.aggregate(places, total, _gram_weight(known, kind, text, n, len(weights)))
    return total


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, model: tuple[float, Sequence[float]] | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, score (the method's probability of block) and verdict."""
    intercept, weights = model or trained()
    host, path = host_path(F.coalesce("url", F.lit("")))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    scored = cut.select("*", rule.alias("rule"), action.alias("action"), logit(F.col("host"), F.col("path"), intercept, weights).alias("z"))
    verdict = F.coalesce("action", F.when(F.col("z") >= 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (1 / (1 + F.exp(-F.col("z")))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")


def sql() -> str:
    intercept, weights = trained()
    sums = [
        f"coalesce(list_sum(list_transform(range(1, length({text}) - {n} + 2), lambda i: w[CAST('0x' || substr(md5('{kind}' || substr({text}, i, {n})), 1, 6) AS INTEGER) % {len(weights)} + 1])), 0)"
        for kind, text in (("h", "host"), ("p", "path"))
        for n in GRAMS
    ]
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    whens = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in longest)
    acts = "".join(f" WHEN rule = '{h}{p}' THEN '{a}'" for a, h, p in RULES)
    return f"""
WITH m AS (SELECT {list(weights)} AS w),
     r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
     x AS (SELECT *, CASE{whens} END AS rule FROM p),
     z AS (SELECT x.*, {intercept} + {" + ".join(sums)} AS z FROM x, m)
SELECT page_id, host, path, rule, CASE{acts} WHEN z >= 0 THEN 'block' ELSE 'allow' END AS verdict FROM z
"""
