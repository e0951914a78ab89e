"""Phrase collocations: counts of word sequences from depth-truncated suffix subtrees, built group by group.

The method follows ERA-style vertical partitioning of a suffix tree:

1. Prefix frequencies: every word is counted per lang by an aggregate that combines on the map side.
2. Vertical partitioning under a memory budget of ``per_group`` suffixes: a first word whose suffixes fit
   is one unit; a first word above the budget (at most ``words / per_group`` of them, so their table has a
   proven bound) is split into ``ceil(f / per_group)`` units by the hash of its second word. Units are dealt
   into ``ceil(words / per_group)`` groups by hash, so a hot word does not make a hot group.
3. Every word occurrence followed by another in its piece starts one *leaf*: the suffix truncated to
   ``DEPTH`` words, sent straight to its group: one exchange. Hot first words are found in the small table
   of step 2, broadcast.
4. Each group builds its subtrees below the first word independently, as an aggregate that keeps the
   group's partitioning (so it spills rather than fails), and reads the count of every node from the totals
   of the leaves below it; every node of two or more words lies wholly in one group. Nodes of one word are
   the prefix frequencies of step 1. Only nodes that occur ``LEAST_COUNT`` times or more are kept, since no
   candidate or part of one is rarer.

Candidates, their cuts and the rule that drops a phrase inside a frequent longer one are joins on the node
table. Scores are exact: products run in 38-digit decimals, and every score is at most 1,000,000 because a
part of a phrase occurs at least as often as the phrase.
"""

from __future__ import annotations

import math
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletry.session import stage

#: Fixed values of the contract: pieces end at these characters, words are runs of anything but blank and tab.
PIECE = r"[.,;:!?\x0A-\x0D]"
WORD = r"[^\x20\x09]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DEPTH = 3
LEAST_COUNT = 10
#: A longer candidate drops a shorter one inside it when 100 * f(longer) >= KEEP_SHARE * f(shorter).
KEEP_SHARE = 50
TOP = 2000
#: Memory budget of one group, in suffixes (word occurrences); about 100 bytes each in a task.
PER_GROUP = 500_000


def _words(docs: DataFrame) -> DataFrame:
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, UPPER.lower())
    pieces = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.explode(F.split(text, PIECE)).alias("piece"))
    return pieces.select("lang", F.explode(F.regexp_extract_all("piece", F.lit(WORD), 0)).alias("w"))


def _leaves(docs: DataFrame) -> DataFrame:
    """(lang, leaf): one row per word occurrence, its suffix in the piece truncated to ``DEPTH`` words."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, UPPER.lower())
    pieces = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.explode(F.split(text, PIECE)).alias("piece"))
    words = pieces.select("lang", F.regexp_extract_all("piece", F.lit(WORD), 0).alias("w")).where(F.size("w") > 0)
    starts = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, DEPTH), " "))
    return words.select("lang", F.explode(starts).alias("leaf"))


def node_counts(docs: DataFrame, per_group: int = PER_GROUP) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of every sequence of 1 to ``DEPTH`` words occurring ``LEAST_COUNT`` times or more,
    and (lang, n), the word occurrences of each lang."""
    freq = stage(_words(docs).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("f")), "phrase-words")
    totals = freq.groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
    words = freq.agg(F.sum("f")).first()[0] or 0
    groups = max(1, math.ceil(words / per_group))
    # At most words / per_group first words are above the budget: a table of proven size.
    hot = freq.where(F.col("f") > per_group).select(
        F.col("lang").alias("hot_lang"), F.col("w").alias("hot_w"), F.ceil(F.col("f") / per_group).alias("parts")
    )
    leaves = _leaves(docs)
    w1, rest = F.substring_index("leaf", " ", 1), F.substring_index(F.substring_index("leaf", " ", 2), " ", -1)
    placed = leaves.join(F.broadcast(hot), (F.col("lang") == F.col("hot_lang")) & (w1 == F.col("hot_w")), "left")
    sub = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(F.when(F.instr("leaf", " ") > 0, rest)), F.col("parts")))
    routed = placed.where(F.instr("leaf", " ") > 0).select(
        F.pmod(F.xxhash64("lang", w1, F.coalesce(sub, F.lit(-1))), F.lit(groups)).alias("grp"), "lang", "leaf"
    ).repartition(groups, "grp")
    # Within a group, each node of 2 or more words is the total of the leaves below it, and all of them are
    # in this group. The aggregate keeps the group's partitioning, so the subtrees are built where the
    # group's suffixes are, without another exchange. Nodes of one word are the prefix frequencies.
    prefixes = F.array(*[F.substring_index("leaf", " ", d) for d in range(2, DEPTH + 1)])
    nodes = routed.select(
        "grp", "lang",
        # A leaf of three words differs from its first two; no regex is needed to tell.
        F.explode(F.when(F.substring_index("leaf", " ", 2) != F.col("leaf"), prefixes).otherwise(F.array("leaf"))).alias("phrase"),
    )
    counted = nodes.groupBy("grp", "lang", "phrase").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= LEAST_COUNT)
    singles = freq.where(F.col("f") >= LEAST_COUNT).select("lang", F.col("w").alias("phrase"), "f")
    return counted.select("lang", "phrase", "f").unionByName(singles), totals


def _score(a: str, left: str, right: str) -> F.Column:
    big = "DECIMAL(38,0)"
    return F.expr(f"CAST(CAST({a} AS {big}) * {a} * 1000000 div (CAST({left} AS {big}) * {right}) AS BIGINT)")


def collocations(docs: DataFrame, top: int = TOP, per_group: int = PER_GROUP) -> DataFrame:
    """Each lang's ``top`` phrases of 2 to 3 words by the score of their weakest cut.

    Returns lang, rank (from 1), phrase (words joined by one blank), a, l, r, n, score, all numbers long.
    ``a`` is the count of the phrase, ``l`` and ``r`` those of the two parts of its lowest-scoring cut
    (ties to the earliest cut), ``n`` all word occurrences of the lang. Order: score descending, a
    descending, phrase ascending in UTF-8 byte order. Null texts and texts without words add nothing; an
    empty table gives no rows; repeated rows count each time; columns beyond text and lang are not read.
    """
    nodes, totals = node_counts(docs.select("text", "lang"), per_group)
    nodes = stage(nodes, "phrase-counts")
    size = F.size(F.split("phrase", " "))
    cands = nodes.where((size >= 2) & (F.col("f") >= LEAST_COUNT)).select("lang", "phrase", F.col("f").alias("a"), size.alias("m"))

    def part(name: str) -> DataFrame:
        return nodes.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_p"), F.col("f").alias(name))

    cuts = []
    for k in (1, 2):
        one = cands.where(F.col("m") > k).select(
            "lang", "phrase", "a", F.lit(k).alias("k"),
            F.substring_index("phrase", " ", k).alias("lw"), F.expr(f"substring_index(phrase, ' ', {k} - m)").alias("rw"),
        )
        lp, rp = part("l"), part("r")
        one = one.join(lp, (one["lang"] == lp["l_lang"]) & (one["lw"] == lp["l_p"])).join(
            rp, (one["lang"] == rp["r_lang"]) & (one["rw"] == rp["r_p"])
        )
        cuts.append(one.select("lang", "phrase", "a", "k", "l", "r", _score("a", "l", "r").alias("score")))
    weakest = cuts[0].unionByName(cuts[1]).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    ).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    # Shorter candidates inside a longer one (contiguously) meet the largest count of those longer ones.
    longer = cands.where(F.col("m") == DEPTH)
    inside = longer.select("lang", F.substring_index("phrase", " ", 2).alias("phrase"), "a").unionByName(
        longer.select("lang", F.substring_index("phrase", " ", -2).alias("phrase"), "a")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (100 * F.col("outer") < KEEP_SHARE * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase",
        F.col("a").cast("long").alias("a"), F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"),
        F.col("n").cast("long").alias("n"), F.col("score").cast("long").alias("score"),
    )
