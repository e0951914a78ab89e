"""Near-duplicate documents by an LSH forest over MinHash signatures."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outletry.llm.hashing import MinHash, as_long, mix, shingles_of, sketch, text_slices, words_of
from outletry.llm.shipping import ship
from outletry.llm.similar import similar_components
from outletry.session import stage

TREES = 16
TREE_DEPTH = 8
#: Largest chance that a pair of the asked similarity meets in no tree.
MISS = 2e-5
#: A region of a tree with more rows than this is descended to the full depth.
DENSE_REGION = 1024
#: Nearest rows in sorted order that become candidates.
NEIGHBOURS = 4
SKETCH_BITS = 128
#: Sketches that differ in no more bits than this are always compared.
LEAST_BITS = 26

_SIGNED = "doc_id long, n long, k1 long, k2 long, s1 long, s2 long, signature binary"


def tuned_forest(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """(depth, sketch bits) for pairs of the given similarity or more.

    Pairs meet in a tree from the depth on, the largest at which all trees miss a pair with probability
    (1 - similarity ** depth) ** TREES of at most ``miss``: 4 and 7e-6 at 0.85, 3 and 1.0e-5 at 0.8.
    A sketch bit differs with probability (1 - similarity) / 2; more bits than these are over five
    standard deviations off. Below 0.49 no depth reaches the recall; then it is 1.
    """
    fits = [d for d in range(1, TREE_DEPTH + 1) if (1 - similarity**d) ** TREES <= miss]
    p = (1 - similarity) / 2
    bits = math.ceil(SKETCH_BITS * p + 5.5 * math.sqrt(SKETCH_BITS * p * (1 - p)))
    return max(fits, default=1), min(max(bits, LEAST_BITS), SKETCH_BITS)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(TREES * TREE_DEPTH)
    salt = np.uint64(0xA24BAED4963EE407)
    for batch in batches:
        for row, end, raw, edges in text_slices(batch):
            shingles, counts = shingles_of(words_of(raw, edges))
            minima = minhash(shingles, counts)
            ends = np.cumsum(counts)
            sets = [np.unique(shingles[e - c : e]) for e, c in zip(ends, counts, strict=True)]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            full = n > 0
            keys = np.zeros((2, len(n)), dtype=np.int64)
            bits = np.zeros((2, len(n)), dtype=np.int64)
            signature = np.zeros((len(n), TREES * TREE_DEPTH), dtype=">u4")
            if full.any():
                flat, starts = np.concatenate(sets), (np.cumsum(n) - n)[full]
                keys[0, full] = as_long(np.add.reduceat(mix(flat ^ salt), starts))
                keys[1, full] = as_long(np.add.reduceat(mix(flat + salt), starts))
                bits[0, full], bits[1, full] = sketch(minima)
                signature[full] = minima
            data = signature.tobytes()
            width = 4 * TREES * TREE_DEPTH
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, end - row),
                    pa.array(n), *map(pa.array, (*keys, *bits)),
                    pa.array([data[k : k + width] for k in range(0, len(data), width)], pa.binary()),
                ],
                names=["doc_id", "n", "k1", "k2", "s1", "s2", "signature"],
            )


def _trees(classes: DataFrame, depth: int) -> DataFrame:
    """One row per class and tree: the label in the tree and the region at ``depth``."""
    width = 4 * TREE_DEPTH
    labels = F.array(*[F.expr(f"substring(signature, {t * width + 1}, {width})") for t in range(TREES)])
    return classes.select("node", "s1", "s2", F.posexplode(labels).alias("tree", "label")).withColumn(
        "region", F.xxhash64("tree", F.expr(f"substring(label, 1, {4 * depth})"))
    )


def candidates(classes: DataFrame, percent: int = 85) -> DataFrame:
    """(a, b) of documents that are neighbours in the sorted order of a tree.

    Within a region the order is that of the labels, so neighbours share the longest prefixes. A
    region with very many rows is split at full depth; its members keep their neighbours in all
    other trees, and ``similar_components`` compares whatever hangs together.
    """
    depth, most_bits = tuned_forest(percent / 100)
    rows = _trees(classes, depth)
    dense = stage(
        rows.groupBy("region").count().where(F.col("count") > DENSE_REGION).select("region", F.lit(True).alias("dense")),
        "dense",
    )
    rows = rows.join(dense, "region", "left").withColumn(
        "region", F.expr("if(dense, xxhash64(tree, label), region)")
    )
    order = Window.partitionBy("region").orderBy("label", "node")
    near = F.array(*[F.lead(F.struct("node", "s1", "s2"), k).over(order) for k in range(1, NEIGHBOURS + 1)])
    close = f"x is not null and bit_count(s1 ^ x.s1) + bit_count(s2 ^ x.s2) <= {most_bits}"
    near = rows.select("node", "s1", "s2", near.alias("near"))
    return near.select(F.col("node").alias("a"), F.explode(F.expr(f"filter(near, x -> {close})")).alias("x")).select(
        "a", F.col("x.node").alias("b")
    )


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text, …).

    Documents whose sets of five-word shingles have 100 * |a & b| >= ``percent`` * |a | b| are linked.

    * A null text, or one without words, has no shingle and is linked with nothing: its component is
      its own id. Fewer than five words are one shingle.
    * Equal sets are one class from the start, however many rows share them.
    * Rows with the same doc_id are one node. A row without doc_id is never compared; it takes the
      component of documents with its very set, if there are any, else null, and is kept only then.
    * Extra columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(docs.mapInArrow(_sign, _SIGNED), "signed")
    classes = stage(
        signed.where("n > 0")
        .groupBy("k1", "k2")
        .agg(
            F.min("doc_id").alias("node"),
            *[F.first(c).alias(c) for c in ("n", "s1", "s2", "signature")],
        )
        .where("node is not null"),
        "classes",
    )
    found = similar_components(
        candidates(classes, percent),
        classes.select("node", "n"),
        # The texts move at every size: members grow with the input, so they are not broadcast.
        lambda members: members.join(docs.withColumnRenamed("doc_id", "node").hint("merge"), "node"),
        percent,
    )
    # A doc_id on rows with different sets can head several classes; all of them are one node.
    heads = classes.select("k1", "k2", "node").join(
        found.groupBy("node").agg(F.min("component").alias("component")), "node", "left"
    ).select("k1", "k2", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "n", "k1", "k2").join(heads, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.expr("coalesce(if(n > 0, component, doc_id) = doc_id, if(n > 0, component, doc_id) is null)").alias("kept"),
    )
