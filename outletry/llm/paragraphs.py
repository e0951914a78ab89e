"""Repeated paragraphs by MinHash banding, and documents without them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outletry.llm.hashing import MinHash, Words, as_long, mix, shingles_of, sketch, text_slices, words_of
from outletry.llm.shipping import ship
from outletry.llm.similar import similar_components
from outletry.session import stage

#: Fewer words are left alone: headings, licence lines and the like repeat rightly. Shorter lines count
#: together with their neighbours. A copy of a passage of over 50 words that is still similar to 0.8 has
#: more words than this.
LEAST_WORDS = 40
MISS = 2e-5
MOST_BANDS = 16
#: Of 64 sketch bits, (1 - J) / 2 differ: at J = 0.8 more than 19 are over five standard deviations off.
MOST_BITS = 19
#: Paragraphs of a bucket that all meet in one row, and those of a larger bucket's chunk.
SMALL_BUCKET = 64
BUCKET_CHUNK = 1024
_NODE_STEP = 10_000_000_000


def tuned_bands(similarity: float, miss: float = MISS, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows) with the most rows, so the fewest chance meetings, whose chance to miss a pair of
    the given similarity is at most ``miss`` with at most ``most`` bands."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))
        if bands <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def _units(counts: np.ndarray, doc: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First line and number of lines of the paragraphs, and of the joins, among lines of ``counts`` words.

    A paragraph is a line of ``least_words`` words or more, or a block of shorter neighbouring lines up to
    a blank or long line that has as many together. A join starts at any shorter line and takes the next
    ones, over blank lines, until it has as many; joins overlap.
    """
    total = np.concatenate([[0], np.cumsum(counts)])
    new = np.append(True, doc[1:] != doc[:-1])

    def ends(inside: np.ndarray) -> np.ndarray:
        breaks = np.flatnonzero(np.append(~inside | new, True))
        return breaks[np.searchsorted(breaks, np.arange(len(counts)), "right")]

    short = counts < least_words
    filled = short & (counts > 0)
    block_ends = ends(filled)
    blocks = np.flatnonzero(filled & (new | ~np.append(False, filled[:-1])))
    blocks = blocks[total[block_ends[blocks]] - total[blocks] >= least_words]
    first = np.concatenate([np.flatnonzero(~short), blocks])
    n_lines = np.concatenate([np.ones(int((~short).sum()), int), block_ends[blocks] - blocks])
    order = np.argsort(first)
    first, n_lines = first[order], n_lines[order]
    joins = np.flatnonzero(filled)
    to = np.searchsorted(total, total[joins] + least_words)
    fits = to <= ends(short)[joins]
    joins, to = joins[fits], to[fits]
    block_end = np.full(len(counts), -1)
    block_end[first] = first + n_lines
    other = to != block_end[joins]
    return first, n_lines, joins[other], (to - joins)[other]


def _lines(batch: pa.RecordBatch, least_words: int):
    """Per slice of a batch: first row, bytes, line edges, document and number of each line, words, units."""
    for row, _, raw, edges in text_slices(batch):
        cuts = np.unique(np.concatenate([edges, np.flatnonzero(raw == 10) + 1]))
        found = words_of(raw, cuts)
        doc = np.searchsorted(edges, cuts[:-1], "right") - 1
        number = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
        yield row, raw, cuts, doc, number, found, _units(found.counts, doc, least_words)


def _sign(batches: Iterable[pa.RecordBatch], bands: int, rows: int, least_words: int) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(max(64, bands * rows))
    salts = [np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)]
    band_salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        ids = batch.column(0)
        for row, _, _, doc, number, found, (first, n_lines, joins, join_lines) in _lines(batch, least_words):
            total = np.concatenate([[0], np.cumsum(found.counts)])

            def signed(first, n_lines, join, row=row, doc=doc, number=number, found=found, total=total):
                counts = total[first + n_lines] - total[first]
                starts = np.cumsum(counts) - counts
                place = np.arange(counts.sum()) - np.repeat(starts, counts)
                take = place + np.repeat(total[first], counts)
                place = place.astype(np.uint64)
                words = Words(found.hashes[take], found.starts[take], found.ends[take], counts)
                keys = [as_long(np.add.reduceat(mix(words.hashes + mix(place ^ s)), starts)) for s in salts]
                columns = [
                    ids.take(pa.array(row + doc[first])),
                    *[pa.array(x.astype(np.int64)) for x in (number[first], n_lines, counts)],
                    pa.array(np.full(len(first), join)),
                    *map(pa.array, keys),
                ]
                if join:
                    return [*columns, pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.list_(pa.int64()))]
                minima = minhash(*shingles_of(words))
                bits = sketch(minima)[0]
                band = np.zeros((len(counts), bands), dtype=np.uint64)
                for r in range(rows):
                    band = mix(band + minima[:, r * bands : (r + 1) * bands] + band_salt)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, band.size + 1, bands), pa.int32()), pa.array(as_long(band).ravel())
                )
                return [*columns, pa.array(bits), lists]

            for units in ((first, n_lines, False), (joins, join_lines, True)):
                if len(units[0]):
                    yield pa.RecordBatch.from_arrays(
                        signed(*units),
                        names=["doc_id", "paragraph", "n_lines", "n_words", "joined", "k1", "k2", "bits", "bands"],
                    )


_SIGNED = (
    "doc_id long, paragraph long, n_lines long, n_words long, joined boolean, k1 long, k2 long, bits long, "
    "bands array<long>"
)


def _texts(batches: Iterable[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, paragraph, text) of all paragraphs, without the joins."""
    for batch in batches:
        for row, raw, cuts, doc, number, _, (first, n_lines, _, _) in _lines(batch, least_words):
            texts = [raw[cuts[a] : cuts[a + n]].tobytes() for a, n in zip(first, n_lines, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row + doc[first])),
                    pa.array(number[first].astype(np.int64)),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "paragraph", "text"],
            )


def _linked(pair: pd.DataFrame) -> pd.DataFrame:
    """Edges that join whatever hangs together by sketches that agree, among the rows of two chunks of a bucket:
    a tree per group instead of all its pairs."""
    node = pair["node"].to_numpy()
    bits = pair["bits"].to_numpy().astype(np.int64).view(np.uint64)
    left = np.arange(len(node))
    a, b = [], []
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            at, reached = reached[0], reached[1:]
            near = np.bitwise_count(bits[left] ^ bits[at]) <= MOST_BITS
            a += [node[at]] * int(near.sum())
            b += list(node[left[near]])
            reached, left = np.concatenate([reached, left[near]]), left[~near]
    return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b) of paragraphs that collide in a band and whose sketches agree, or a chain of such pairs.

    In a bucket of up to ``SMALL_BUCKET`` paragraphs every one meets every other. A larger bucket is dealt into
    chunks, and every two of them meet in one task, which joins what hangs together without listing all pairs.
    """
    rows = classes.select("node", "bits", F.explode("bands").alias("band"))
    sizes = stage(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(f"n > {SMALL_BUCKET}"), "large_buckets")
    order = Window.partitionBy("band").orderBy("node").rowsBetween(1, SMALL_BUCKET - 1)
    near = F.collect_list(F.struct("node", "bits")).over(order)
    close = f"x.node <> node and bit_count(bits ^ x.bits) <= {MOST_BITS}"
    small = rows.join(sizes, "band", "left_anti").select("node", "bits", near.alias("near"))
    small = small.select(F.col("node").alias("a"), F.explode(F.expr(f"filter(near, x -> {close})")).alias("x")).select(
        "a", F.col("x.node").alias("b")
    )
    if sizes.isEmpty():
        return small
    ship(classes.sparkSession)
    dealt = rows.join(sizes, "band").withColumn("chunks", F.expr(f"cast(ceil(n / {BUCKET_CHUNK}) as int)"))
    dealt = dealt.withColumn("chunk", F.expr("cast(pmod(xxhash64(node), chunks) as int)")).select(
        "node", "bits", "band", "chunk", F.explode(F.expr("sequence(0, chunks - 1)")).alias("other")
    )
    pairs = dealt.select(
        "node", "bits", "band", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
    )
    kind = classes.schema["node"].dataType.simpleString()
    large = pairs.groupBy("band", "low", "high").applyInPandas(lambda p: _linked(p), f"a {kind}, b {kind}")
    return small.unionAll(large.where("a <> b"))


def repeated_paragraphs(docs: DataFrame, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """Paragraphs of ``least_words`` words or more that occur again, in the same or another document.

    A paragraph is a line, or a block of shorter neighbouring lines between blank or long ones. Two
    paragraphs are the same passage if their sets of five-word shingles have 100 * |a & b| >=
    ``percent`` * |a | b|, or if a chain of such pairs joins them. Shorter lines are also joined, from
    every line on, until they have ``least_words`` words; joins overlap, so that only equal words make
    two of them, or one and a paragraph, the same passage. Returns doc_id, paragraph (the number of its
    first line, from 0), n_lines, n_words, first_doc_id and first_paragraph (the occurrence with the
    smallest doc_id and line of the whole group), and removed (every occurrence but that one).

    * Null, empty and short texts have no such paragraph. A row without doc_id takes no part.
    * Rows that share a doc_id are one document: equal lines at the same place are one occurrence.
    * What overlaps the first occurrence of its group is no other one and is left out.
    * Extra columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    bands, rows = tuned_bands(percent / 100)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).where("doc_id is not null")
    signed = stage(docs.mapInArrow(lambda b: _sign(b, bands, rows, least_words), _SIGNED), "paragraphs")
    # A block and a join may start at the same line.
    place = f"cast(cast(doc_id as decimal(20,0)) * {_NODE_STEP} + {{}} as decimal(38,0))"
    signed = signed.withColumn("node", F.expr(place.format("(2 * paragraph + cast(joined as long))")))
    classes = stage(
        signed.groupBy("k1", "k2").agg(
            F.min(F.struct("node", "n_lines")).alias("first"),
            F.max("node").alias("last"),
            F.min(F.expr("if(joined, null, node)")).alias("node"),
            *[F.first(c, ignorenulls=True).alias(c) for c in ("n_words", "bits", "bands")],
        ).where("node is not null or last > first.node"),
        "classes",
    )

    def with_text(members: DataFrame) -> DataFrame:
        texts = docs.mapInArrow(lambda b: _texts(b, least_words), "doc_id long, paragraph long, text string")
        return members.join(texts.select(F.expr(place.format("2 * paragraph")).alias("node"), "text"), "node")

    units = classes.where("node is not null")
    found = similar_components(
        candidates(units), units.select("node", F.col("n_words").alias("n")), with_text, percent
    )
    found = stage(found.groupBy("node").agg(F.min("component").alias("component")), "found")
    known = classes.select("k1", "k2", "node", "first", "last").join(found, "node", "left")
    # A join may be the first occurrence of a paragraph's group.
    heads = known.where("component is not null").groupBy("component").agg(F.min("first").alias("head"))
    groups = known.join(heads, "component", "left").where("last > first.node or component is not null").select(
        "k1", "k2", F.expr("coalesce(head, first)").alias("head")
    )
    out = signed.select("doc_id", "paragraph", "n_lines", "n_words", "node", "k1", "k2").join(groups, ["k1", "k2"])
    first_doc = f"cast(floor(head.node / {_NODE_STEP}) as long)"
    first_line = f"cast(floor((head.node - cast({first_doc} as decimal(20,0)) * {_NODE_STEP}) / 2) as long)"
    out = out.withColumns({"first_doc_id": F.expr(first_doc), "first_paragraph": F.expr(first_line)})
    return out.where(
        "node = head.node or doc_id <> first_doc_id or paragraph >= first_paragraph + head.n_lines"
    ).select(
        "doc_id", "paragraph", "n_lines", "n_words", "first_doc_id", "first_paragraph",
        F.expr("node <> head.node").alias("removed"),
    ).distinct()


def without_repeats(docs: DataFrame, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with every later occurrence of a repeated paragraph cut out; n_chars follows the text.

    Other columns stay as they are, and so does every text without a removed line. A document keeps
    its row even if nothing is left of its text.
    """
    removed = repeated_paragraphs(docs, percent, least_words).where("removed").select(
        "doc_id", F.explode(F.expr("sequence(paragraph, paragraph + n_lines - 1)")).alias("paragraph")
    ).groupBy("doc_id").agg(F.collect_set("paragraph").alias("_lines"))
    removed = removed.withColumnRenamed("doc_id", "_id")
    joined = docs.join(removed, docs["doc_id"] == removed["_id"], "left")
    rest = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(_lines, cast(i as long))), '\\n')")
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(rest)
    changes = {"text": text}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("_lines").isNull(), F.col("n_chars")).otherwise(
            F.length(rest).cast(docs.schema["n_chars"].dataType)
        )
    return joined.select(*[changes.get(c, docs[c]).alias(c) for c in docs.columns])
