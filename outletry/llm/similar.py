"""From candidate pairs of texts to exact components of similar texts, in bounded tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletry.llm.components import components
from outletry.llm.hashing import shingles_of, sorted_groups, text_slices, words_of
from outletry.llm.shipping import ship
from outletry.session import stage

#: Shingles of one chunk of a family; a task holds two chunks at most.
CHUNK_SHINGLES = 200_000


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component label of every set, where 100 * |a & b| >= percent * |a | b| links two sets.

    The set nearest to the consensus goes first: in a family of edited copies it is close to the
    original and links nearly all. Later only sets outside its component are compared with all
    others, which covers every pair whose ends are in different components.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    label = np.arange(m)
    if m == 1:
        return label
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.zeros(2, int) if 100 * both >= percent * (sizes.sum() - both) and both else label
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(-np.bincount(owner, counts[ids], m) / np.maximum(sizes, 1), kind="stable")
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(counts), dtype=bool)
    for turn, p in enumerate(order):
        if turn and label[p] == label[order[0]]:
            continue
        mine = ids[starts[p] : starts[p] + sizes[p]]
        marked[mine] = True
        both = np.bincount(owner[marked[ids]], minlength=m)
        marked[mine] = False
        hit = (100 * both >= percent * (sizes + sizes[p] - both)) & (both > 0) & (label != label[p])
        if hit.any():
            label[np.isin(label, np.append(label[hit], label[p]))] = label[p]
            if (label == label[p]).all():
                break
    return label


def _verify(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    keys = ["family", "low", "high"]
    for table in sorted_groups(batches, keys):
        sets: list[np.ndarray] = []
        for batch in table.to_batches():
            for _, _, raw, edges in text_slices(batch):
                shingles, counts = shingles_of(words_of(raw, edges))
                ends = np.cumsum(counts)
                sets += [np.unique(shingles[e - c : e]) for e, c in zip(ends, counts, strict=True)]
        same = np.ones(table.num_rows - 1, dtype=bool)
        for key in keys:
            values = table.column(key).to_numpy()
            same &= values[1:] == values[:-1]
        cuts = [0, *(np.flatnonzero(~same) + 1), table.num_rows]
        nodes = table.column("node").to_pylist()
        root = list(nodes)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            label = linked(sets[a:b], percent)
            least: dict[int, object] = {}
            for k, x in enumerate(label):
                least[x] = min(least.get(x, nodes[a + k]), nodes[a + k])
            root[a:b] = [least[x] for x in label]
        yield pa.RecordBatch.from_arrays(
            [
                table.column("node").combine_chunks(),
                pa.array(root, table.schema.field("node").type),
                table.column("whole").combine_chunks(),
            ],
            names=["node", "root", "whole"],
        )


def similar_components(
    pairs: DataFrame,
    sizes: DataFrame,
    with_text: Callable[[DataFrame], DataFrame],
    percent: int,
    chunk: int = CHUNK_SHINGLES,
) -> DataFrame:
    """(node, component) of nodes linked with another one; the component is its smallest node.

    ``pairs`` (a, b) are candidates, ``sizes`` (node, n) bounds the shingles of each node, and
    ``with_text`` adds the whole text to a table that has ``node``. Candidates are first joined to
    families. A family is then compared exactly, on full shingle sets: in one task if it is small,
    else in tasks of two of its chunks each, so that every pair of members meets and none is emitted.
    """
    ship(pairs.sparkSession)
    family = components(pairs, "a", "b").withColumnRenamed("component", "family")
    members = stage(family.join(sizes, "node"), "members")
    total = members.groupBy("family").agg(
        F.ceil(F.sum("n") / F.lit(chunk)).cast("int").alias("chunks")
    )
    members = members.join(total, "family").withColumn(
        "own", F.expr("cast(pmod(xxhash64(node, 'chunk'), chunks) as int)")
    )
    other = F.explode(
        F.expr("if(chunks = 1, array(0), filter(sequence(0, chunks - 1), x -> x <> own))")
    )
    members = members.select("node", "family", "own", (F.col("chunks") == 1).alias("whole"), other.alias("other"))
    placed = with_text(
        members.select(
            "node", "family", "whole", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
        )
    ).select("node", "family", F.col("low").cast("long"), F.col("high").cast("long"), "whole", "text")
    placed = placed.withColumn("family", F.xxhash64("family"))
    # A clash of hashed families only puts two families into one comparison.
    spread = placed.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
    node_type = dict(placed.dtypes)["node"]
    found = stage(
        spread.mapInArrow(
            lambda batches: _verify(batches, percent), f"node {node_type}, root {node_type}, whole boolean"
        ),
        "verified",
    )
    small = found.where("whole and node <> root").select("node", F.col("root").alias("component")).distinct()
    tops = small.select(F.col("component").alias("node"), "component").distinct()
    return small.unionAll(tops).unionAll(components(found.where("not whole"), "node", "root"))
