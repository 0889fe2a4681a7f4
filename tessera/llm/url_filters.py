"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests.

Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join compares (32 bits), before the whole digest is compared.
SHORT = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge(df: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Return ``id, host, path, rule, verdict`` for each row of ``df``; its other columns are ignored.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains where the path begins with the rule's.
    The longest fitting rule (host and path together, then the host) wins; between equal ones ``block`` wins. Rules with a
    null are ignored. Where none fits, ``rule`` is null and ``verdict`` is ``default``. Null urls and urls without ``://``
    have an empty host and path and fit no rule. Rows stay as they are, repeated ids and urls included; empty tables give
    empty results.

    Each distinct url is expanded into the host suffixes and path prefixes of just those lengths that some rule has, so the
    expansion is bounded by the rules and misses none of them. No side is broadcast by hint.
    """
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    shape = rules.agg(F.collect_set(_labels(F.col("host"))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])

    rows = df.select(F.col(id).alias("__id"), F.col(url).alias("__url"))
    urls = rows.where(F.instr("__url", "://") > 0).select("__url").distinct()
    urls = urls.withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})

    def part(host: bool, n: int) -> Column:
        if host:
            return F.when(_labels(F.col("__host")) >= n, F.substring_index("__host", ".", -n))
        return F.when(F.length("__path") >= n, F.substring("__path", 1, n))

    hosts = F.array_compact(F.array(*[part(True, n) for n in labels])) if labels else F.array().cast("array<string>")
    paths = F.array_compact(F.array(*[part(False, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    expressions = (
        urls.select("__url", F.explode(hosts).alias("__suffix"), paths.alias("__prefixes"))
        .select("__url", "__suffix", F.explode("__prefixes").alias("__prefix"))
        .select("__url", _digest(F.col("__suffix"), F.col("__prefix")).alias("__full"))
        .withColumn("__short", F.substring("__full", 1, SHORT))
    )
    known = rules.select(
        _digest(F.col("host"), F.col("path")).alias("__rule_full"),
        F.struct(
            F.length(F.concat("host", "path")).alias("length"),
            F.length("host").alias("of_host"),
            (F.col("verdict") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("verdict"),
        ).alias("__rule"),
    ).withColumn("__short", F.substring("__rule_full", 1, SHORT))
    best = expressions.join(known, "__short").where(F.col("__full") == F.col("__rule_full")).groupBy("__url").agg(F.max("__rule").alias("__best"))
    return rows.join(best, "__url", "left").select(
        F.col("__id").alias(id),
        host_of(F.col("__url")).alias("host"),
        path_of(F.col("__url")).alias("path"),
        F.col("__best.rule").alias("rule"),
        F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"),
    )
