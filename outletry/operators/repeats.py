"""Repeated rows: the first one by row id stays, later ones are marked.

The rows are written once with one 64-bit hash each, so the chain that cleans them runs once. Only hashes travel to
find those that occur again, combined on the map side. The keys behind them, few in clean data and few in a small
calendar, are counted and written with their smallest row id; every row then meets that table in one equi-join,
broadcast if its measured size allows and else split by adaptive execution where one key is hot. Nothing is joined
back by row id, so a row id that several rows share can neither multiply rows nor mark a first row by mistake.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outletry.session import stage

ROW_ID = "_row_id"
REPEAT = "_is_repeat"


def mark_repeats(
    df: DataFrame, keys: Sequence[str], row_id: str = ROW_ID, among: Column | None = None
) -> DataFrame:
    """Add ``_is_repeat``: true for every row but the first of its key, ordered by ``row_id``.

    Null key values are equal to each other. With ``among`` only rows fulfilling it take part; the others
    are false. A null row id comes after all others. Rows equal in their keys and their row id are copies of
    one row: exactly one of them stays, which one is immaterial as they agree on every column that decides.
    The result has the rows of ``df``, each once, in no particular order. ``df`` and the first ids are staged.
    """
    names = [f"_rk{i}_" for i in range(len(keys))]
    taking = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    rows = stage(df.withColumn("_rcode_", F.when(taking, F.xxhash64(*keys))), "hashed")
    seen = stage(
        rows.where(F.col("_rcode_").isNotNull())
        .groupBy("_rcode_").agg(F.count(F.lit(1)).alias("_rn_"))
        .where("_rn_ > 1").select("_rcode_"),
        "repeated_hashes",
    )
    again = rows.select(*dict.fromkeys([*keys, row_id]), "_rcode_").join(seen, "_rcode_", "left_semi")
    # Hashes may collide, so the whole key decides; null ids come last.
    ids = again.groupBy(
        F.col("_rcode_").alias("_rseen_"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        F.col(row_id).alias("_rid_"),
    ).agg(F.count(F.lit(1)).alias("_rn_"))
    firsts = stage(
        ids.groupBy("_rseen_", *names)
        .agg(F.min(F.struct(F.col("_rid_").isNull().alias("last"), "_rid_", "_rn_")).alias("_rm_"))
        .select("_rseen_", *names, F.col("_rm_._rid_").alias("_rfirst_"), F.col("_rm_._rn_").alias("_rties_")),
        "first_ids",
    )
    same_key = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)],
        F.col("_rcode_") == F.col("_rseen_"),
    )
    met = rows.join(firsts, same_key, "left")
    at_first = F.col(row_id).eqNullSafe(F.col("_rfirst_"))
    later = F.col("_rseen_").isNotNull() & ~at_first
    if firsts.where("_rties_ > 1").isEmpty():
        return met.select(*df.columns, later.alias(REPEAT))
    # Rows that tie on the first id of their key: exactly one of them stays.
    tie = F.coalesce(at_first & (F.col("_rties_") > 1), F.lit(False))
    tied = Window.partitionBy(*keys, row_id).orderBy(row_id)
    return met.where(~tie).select(*df.columns, later.alias(REPEAT)).unionByName(
        met.where(tie).select(*df.columns, (F.row_number().over(tied) > 1).alias(REPEAT))
    )


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on more than one row, most frequent first."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where("row_count > 1")
        .orderBy(F.desc("row_count"), *keys)
    )
