"""URL rules by hashed host-suffix and path-prefix expressions, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"://([^/?#]*)([^?#]*)"
#: Hex digits of the digest that the join compares; the whole digest is confirmed afterwards.
PREFIX_DIGITS = 8

# The rules of the query, as (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, _PARTS, 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def _filed(rules: DataFrame) -> DataFrame:
    """Rules with the expression they are filed under: host, and path up to its last slash."""
    host = F.translate("host", _UPPER, _UPPER.lower())
    stem = F.regexp_extract("path", "^(?s)(.*/)?", 0)
    rules = rules.where("host <> '' and path is not null and verdict in ('allow', 'block')")
    return rules.select(
        host.alias("rule_host"), F.col("path").alias("rule_path"), "verdict",
        F.size(F.split(host, r"\.")).alias("labels"), F.regexp_count(stem, F.lit("/")).alias("slashes"),
        _digest(host, stem).alias("digest"),
    )


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Adds host, path, rule (host and path of the rule that wins, or null) and verdict to ``pages`` (url).

    A rule (host, path, verdict) fits its host and all subdomains if the path of the url starts with its
    own. Of several, the longest text wins, then the longer host, then ``block``. Without one the verdict
    is ``otherwise``.

    Every distinct (host, path) is expanded once into its host suffixes times the prefixes of its path that
    end in a slash, no deeper than any rule. Expressions and rules meet on the first digits of a digest;
    the whole digest and the rest of the rule's path confirm. Pages then take the rule of their pair, so
    copies of a url cost one row of a join, which can be split.

    * A null url, or one without ``://``, has an empty host and path and fits no rule.
    * Rules with an empty or null host, a null path or another verdict are ignored. With no rules every
      page gets ``otherwise``. Repeated pages are judged each; empty tables stay empty.
    * Columns of ``pages`` named host, path, rule or verdict are replaced; all others stay.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    filed = _filed(rules)
    depth = filed.agg(
        F.coalesce(F.max("labels"), F.lit(0)).alias("labels"), F.coalesce(F.max("slashes"), F.lit(0)).alias("slashes")
    ).first()
    pairs = pages.where("host <> ''").select("host", "path").distinct()
    hosts = F.expr(
        f"""transform(sequence(1, least(size(split(host, '\\\\.')), {max(depth['labels'], 1)})),
              k -> substring_index(host, '.', -k))"""
    )
    stems = F.expr(
        f"""concat(array(''), transform(
              filter(sequence(0, least(regexp_count(path, '/'), {depth['slashes']})), k -> k > 0),
              k -> concat(substring_index(path, '/', k), '/')))"""
    )
    spread = pairs.select("host", "path", F.explode(hosts).alias("suffix"), stems.alias("stems"))
    spread = spread.select("host", "path", "suffix", F.explode("stems").alias("stem"))
    spread = spread.withColumn("full", _digest(F.col("suffix"), F.col("stem")))
    spread = spread.withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    filed = filed.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    met = spread.join(filed, "short").where("full = digest and startswith(path, rule_path)")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("all"), F.length("rule_host").alias("host"),
        (F.col("verdict") == "block").alias("block"),
    )
    best = met.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best")
    )
    names = [c for c in pages.columns if c not in ("host", "path")]
    return pages.join(best, ["host", "path"], "left").select(
        *names, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )
