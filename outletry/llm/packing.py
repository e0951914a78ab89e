"""Batches of documents of similar length: optimal length buckets and token budgets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outletry.llm.encoding import encoder
from outletry.llm.shipping import ship
from outletry.session import stage

MAX_LENGTH = 4096
BUCKETS = 16
BATCH_TOKENS = 65_536
#: Rows that one task numbers; a bucket is numbered in as many slices as it needs.
SLICE_ROWS = 20_000


def _count(batches: Iterable[pa.RecordBatch], tokenizer: str, per_word: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer, per_word)
    width = np.dtype(encode.kind).itemsize
    for batch in batches:
        n = [len(encode(text.as_py())) // width + 1 for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])


def token_lengths(docs: DataFrame, tokenizer: str, per_word: bool = False) -> DataFrame:
    """(doc_id, n_tokens) of every row, with one more for the id that ends a document; null texts have that one."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _count(b, tokenizer, per_word), "doc_id long, n_tokens long")


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of length with the least padding in total.

    ``lengths`` are distinct and ascending. Every row is padded to the bound of its bucket; the last bound
    is the largest length. Dynamic programming over (bounds used, last bound); equal costs take the
    smaller bound before.
    """
    if not len(lengths):
        return []
    size = len(lengths)
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    best = lengths.astype(np.int64) * total[1:]
    back = [np.zeros(size, dtype=np.int64)]
    for _ in range(min(buckets, size) - 1):
        before = np.concatenate([[0], best])
        nxt, choice = np.empty(size, dtype=np.int64), np.empty(size, dtype=np.int64)
        for a in range(0, size, 256):
            ends = np.arange(a, min(a + 256, size))
            cost = before[None, :] + lengths[ends].astype(np.int64)[:, None] * (total[ends + 1][:, None] - total[None, :])
            cost[np.arange(size + 1)[None, :] > ends[:, None]] = np.iinfo(np.int64).max
            choice[ends] = cost.argmin(axis=1)
            nxt[ends] = cost.min(axis=1)
        best, _ = nxt, back.append(choice)
    bounds, end = [], size
    for choice in reversed(back):
        if end <= 0:
            break
        bounds.append(int(lengths[end - 1]))
        end = int(choice[end - 1])
    return bounds[::-1]


def pack(
    lengths: DataFrame,
    max_length: int = MAX_LENGTH,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """doc_id, piece, start, length, padded_length, bucket, batch and place of every piece of every document.

    ``lengths`` has (doc_id, n_tokens). A document longer than ``max_length`` is cut into pieces of that
    length and a rest. The histogram of piece lengths, of at most ``max_length`` rows, gives the bounds
    with the least padding; a batch of a bucket holds as many pieces as fit ``batch_tokens`` when padded,
    one at least, and only the last batch of a bucket may hold fewer.

    * A null or non-positive length is a document without tokens and has no piece.
    * Pieces of a bucket are taken in the order of a hash; repeated rows are packed each.
    * Empty tables give empty results; extra columns are ignored.
    """
    spark = lengths.sparkSession
    n = F.col("n_tokens")
    cut = F.explode(F.expr(f"sequence(0L, cast((n_tokens - 1) div {max_length} as bigint))"))
    pieces = lengths.where(n > 0).select("doc_id", n.cast("long").alias("n_tokens"), cut.alias("piece"))
    pieces = pieces.select(
        "doc_id", "piece", (F.col("piece") * max_length).alias("start"),
        F.least(F.lit(max_length), n - F.col("piece") * max_length).alias("length"),
    )
    pieces = stage(pieces, "pieces")
    histogram = pieces.groupBy("length").count().orderBy("length").toPandas()
    bounds = bucket_bounds(histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets)
    total = int(histogram["count"].sum())
    slices = max(1, -(-total // slice_rows))
    upper = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0))
    placed = pieces.withColumn("bucket", F.size(F.filter(upper, lambda b: b < F.col("length"))))
    placed = placed.withColumn("padded_length", F.element_at(upper, F.col("bucket") + 1).cast("long")).withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(slices))
    )
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "slice").count().select(
        "bucket", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    order = Window.partitionBy("bucket", "slice").orderBy("doc_id", "piece", "length")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["bucket", "slice"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("offset")).withColumn(
        "room", F.greatest(F.lit(1), F.expr(f"{batch_tokens} div padded_length"))
    )
    return ranked.select(
        "doc_id", "piece", "start", "length", "padded_length", F.col("bucket").cast("long").alias("bucket"),
        F.expr("rank div room").alias("batch"), F.expr("rank % room").alias("place"),
    )
