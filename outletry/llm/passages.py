"""Passages that occur again anywhere in the texts, also inside longer lines, and documents without them.

A passage is found by its windows of ``WINDOW`` words. The key of a window is the smallest hash of its runs of ``GRAM``
words (winnowing), so equal windows have equal keys and neighbouring windows mostly share one: about one row for eleven
words travels to find the keys that occur again. Only the windows behind those keys are then compared, by key and 64
more bits. Neighbouring windows with one key are compared as one row where all runs of that key are equal, as they are
inside a copied passage; they are listed one by one only where its runs differ, as at the ends of one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletry.llm.hashing import Words, _Powers, as_long, mix, text_slices, words_of
from outletry.llm.paragraphs import LEAST_WORDS, repeated_paragraphs
from outletry.llm.shipping import ship
from outletry.session import stage

#: Words of a window: what is found again has as many or more, like a paragraph.
WINDOW = LEAST_WORDS
GRAM = WINDOW // 2
#: Runs of GRAM words in a window. More neighbouring windows than this with one key hold its run twice.
_GRAMS = WINDOW - GRAM + 1
_SALTS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)

_RUNS = "doc_id long, key long, start long, n long"
_WINDOWS = (
    "key long, code long, twin boolean, n long, doc_id long, word long, paragraph long, last_paragraph long, "
    "windows array<struct<code:long,paragraph:long,last_paragraph:long>>"
)


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbouring words; runs over the end of a text are among them."""
    up, down = _Powers.upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    n = len(hashes) - size + 1
    return mix((total[size:] - total[:n]) * down[:n])


def _keys(hashes: np.ndarray) -> np.ndarray:
    """Smallest hash of the runs of GRAM words in every window."""
    least, wide = _rolled(hashes, GRAM), 1
    while 2 * wide <= _GRAMS:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    rest = _GRAMS - wide
    return np.minimum(least[: len(least) - rest], least[rest:])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First window and number of neighbouring windows that share a key."""
    for batch in batches:
        for row, _, raw, edges in text_slices(batch):
            words = words_of(raw, edges)
            if len(words.hashes) < WINDOW:
                continue
            doc = np.repeat(np.arange(len(words.counts)), words.counts)
            at = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
            if not len(at):
                continue
            key = _keys(words.hashes)[at]
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])))
            starts = (np.cumsum(words.counts) - words.counts)[doc[at[first]]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row + doc[at[first]])),
                    pa.array(as_long(key[first])),
                    pa.array((at[first] - starts).astype(np.int64)),
                    pa.array(np.diff(np.append(first, len(at))).astype(np.int64)),
                ],
                names=["doc_id", "key", "start", "n"],
            )


def _each_text(batch: pa.RecordBatch) -> Iterator[tuple[int, Words, np.ndarray]]:
    """Row, words and the line of each word of every text of a batch."""
    for row, end, raw, edges in text_slices(batch):
        for k in range(row, end):
            own = raw[edges[k - row] : edges[k - row + 1]]
            words = words_of(own, np.array([0, len(own)]))
            yield k, words, np.searchsorted(np.flatnonzero(own == 10), words.starts)


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted runs with their windows, cut where a window touches a line in ``gone``.

    The code of a run is that of all its windows in order; a run in which two windows are equal is a ``twin``.
    """
    for batch in batches:
        runs, gone, ids = batch.column("runs"), batch.column("gone"), batch.column("doc_id")
        for k, words, line in _each_text(batch):
            n = len(words.hashes) - WINDOW + 1
            wanted = np.zeros(max(n, 0), dtype=bool)
            for run in runs[k].as_py():
                wanted[run["start"] : run["start"] + run["n"]] = True
            lines = gone[k].as_py()
            if lines and n > 0:
                lost = np.concatenate([[0], np.cumsum(np.isin(line, lines))])
                wanted &= lost[WINDOW:] == lost[:n]
            at = np.flatnonzero(wanted)
            if not len(at):
                continue
            key = _keys(words.hashes)[at]
            code = _rolled(mix(words.hashes ^ np.uint64(_SALTS[0])), WINDOW)[at]
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])))
            sizes = np.diff(np.append(first, len(at)))
            run = np.repeat(np.arange(len(first)), sizes)
            place = (np.arange(len(at)) - first[run]).astype(np.uint64)
            whole = np.add.reduceat(mix(code + mix(place ^ np.uint64(_SALTS[1]))), first)
            order = np.lexsort((code, run))
            equal = (code[order][1:] == code[order][:-1]) & (run[order][1:] == run[order][:-1])
            twin = np.zeros(len(first), dtype=bool)
            twin[run[order][1:][equal]] = True
            last = first + sizes - 1
            places = [x.astype(np.int64) for x in (line[at], line[at + WINDOW - 1])]
            windows = pa.StructArray.from_arrays(
                [pa.array(as_long(code)), *map(pa.array, places)], names=["code", "paragraph", "last_paragraph"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(as_long(key[first])),
                    pa.array(as_long(mix(whole + sizes.astype(np.uint64)))),
                    pa.array(twin),
                    pa.array(sizes.astype(np.int64)),
                    ids.take(pa.array(np.full(len(first), k))),
                    pa.array(at[first].astype(np.int64)),
                    pa.array(places[0][first]),
                    pa.array(places[1][last]),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), windows),
                ],
                names=["key", "code", "twin", "n", "doc_id", "word", "paragraph", "last_paragraph", "windows"],
            )


def _cut(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Texts without their lines in ``_gone`` and the words of ``_spans``; a line left without a word goes too."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        spans, gone = batch.column("_spans").to_pylist(), batch.column("_gone").to_pylist()
        for k in [k for k, t in enumerate(texts) if t is not None and (spans[k] or gone[k])]:
            raw = np.frombuffer(texts[k].encode(), dtype=np.uint8)
            words = words_of(raw, np.array([0, len(raw)]))
            keep, touched, lost = np.ones(len(raw), dtype=bool), set(), set(gone[k] or ())
            ends = np.append(np.flatnonzero(raw == 10), len(raw))
            for s in spans[k] or ():
                from_word, to_word = s["from_word"], min(s["to_word"], len(words.starts))
                for w in range(from_word, to_word):
                    line = int(np.searchsorted(ends, words.starts[w]))
                    touched.add(line)
                    last = w + 1 == len(words.starts) or words.starts[w + 1] > ends[line]
                    keep[words.starts[w] : ends[line] if last else words.starts[w + 1]] = False
            kept = []
            for line, (a, b) in enumerate(zip(np.append(0, ends[:-1] + 1), ends, strict=True)):
                piece = raw[a:b][keep[a:b]].tobytes()
                if line not in lost and (line not in touched or piece.strip()):
                    kept.append(piece)
            texts[k] = b"\n".join(kept).decode()
        out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        yield out.select(columns)


def _units(found: DataFrame) -> DataFrame:
    """Rows of ``n`` neighbouring windows: two have a window in common only if their key and code are the same.

    Equal windows have equal keys. So the runs of a key stay whole if all are equal and none has equal windows inside.
    """
    mixed = stage(
        found.groupBy("key").agg(
            F.min("code").alias("low"), F.max("code").alias("high"), F.max("twin").alias("twin")
        ).where("low <> high or twin").select("key"),
        "mixed_keys",
    )
    columns = ["key", "code", "doc_id", "word", "n", "paragraph", "last_paragraph"]
    whole = found.join(mixed, "key", "left_anti").select(*columns)
    single = found.join(mixed, "key", "left_semi").select("key", "doc_id", "word", F.posexplode("windows"))
    return whole.unionByName(
        single.select(
            "key", "doc_id", (F.col("word") + F.col("pos")).alias("word"), F.lit(1).cast("long").alias("n"), "col.*"
        )
    )


def repeated_passages(docs: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Runs of words all of whose windows of ``WINDOW`` words occur again, in the same or another document.

    Words are separated by white space, A-Z count as a-z, and a window may run over line ends. ``gone`` (doc_id,
    paragraph) names lines that are taken out already: no window touches one. Returns doc_id, paragraph (the line of
    the first word, from 0), n_lines and n_words of a run, first_doc_id and first_paragraph (where its first window
    occurs first, by doc_id and word), removed (false for runs of such first windows), and from_word (the number of
    its first word in the text, from 0).

    * Null and short texts have no window. A row without doc_id takes no part.
    * Rows that share a doc_id are one document: equal windows at the same word are one occurrence.
    * A window that overlaps its own first occurrence is no other one.
    """
    ship(docs.sparkSession)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).where("doc_id is not null")
    runs = stage(docs.mapInArrow(_runs, _RUNS), "runs")
    again = runs.groupBy("key").agg(F.sum(F.expr(f"if(n > {_GRAMS}, 2, 1)")).alias("times")).where("times > 1")
    wanted = runs.join(again, "key", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("start", "n")).alias("runs")
    )
    todo = docs.join(wanted, F.col("doc_id") == F.col("_id")).drop("_id")
    if gone is None:
        todo = todo.withColumn("gone", F.expr("cast(null as array<long>)"))
    else:
        lines = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("paragraph").alias("gone"))
        todo = todo.join(lines, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    found = stage(todo.select("doc_id", "text", "runs", "gone").mapInArrow(_windows, _WINDOWS), "windows")
    units = stage(_units(found), "units")
    firsts = stage(
        units.groupBy("key", "code").agg(
            F.min(F.struct("doc_id", "word", "paragraph")).alias("first"), F.max(F.struct("doc_id", "word")).alias("last")
        ).where(f"last.doc_id <> first.doc_id or last.word >= first.word + {WINDOW}").drop("last"),
        "first_windows",
    )
    met = units.join(firsts, ["key", "code"]).withColumn(
        "removed", F.expr("not (doc_id = first.doc_id and word = first.word)")
    ).where(f"not removed or doc_id <> first.doc_id or word >= first.word + {WINDOW}")
    order = Window.partitionBy("doc_id", "removed").orderBy("word")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.col("word") > F.max(F.col("word") + F.col("n") - 1).over(before) + WINDOW, F.lit(False))
    spans = met.withColumn("_gap", gap.cast("int")).withColumn("_span", F.sum("_gap").over(order))
    return spans.groupBy("doc_id", "removed", "_span").agg(
        F.min("word").alias("from_word"),
        (F.max(F.col("word") + F.col("n") - 1) + WINDOW - F.min("word")).alias("n_words"),
        F.min("paragraph").alias("paragraph"),
        (F.max("last_paragraph") - F.min("paragraph") + 1).alias("n_lines"),
        F.min_by("first", "word").alias("first"),
    ).select(
        "doc_id", "paragraph", "n_lines", "n_words", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.paragraph").alias("first_paragraph"), "removed", "from_word",
    )


def _gone(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, paragraph) of the lines of removed paragraphs."""
    return paragraphs.where("removed").select(
        "doc_id", F.explode(F.expr("sequence(paragraph, paragraph + n_lines - 1)")).alias("paragraph")
    )


def repeats(docs: DataFrame) -> DataFrame:
    """The repeated paragraphs (from_word null), and the passages repeated in what is left without those removed."""
    paragraphs = stage(repeated_paragraphs(docs), "repeated_paragraphs")
    passages = repeated_passages(docs, _gone(paragraphs))
    return paragraphs.withColumn("from_word", F.lit(None).cast("long")).unionByName(passages)


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the later occurrences of repeated paragraphs and passages; n_chars follows the text.

    Other columns stay as they are, and so does every text without one. A document keeps its row even if nothing is
    left of its text.
    """
    found = stage(repeats(docs).where("removed"), "repeats")
    gone = _gone(found.where("from_word is null")).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set("paragraph").alias("_gone")
    )
    spans = found.where("from_word is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("from_word", F.expr("from_word + n_words").alias("to_word"))).alias("_spans")
    )
    cuts = gone.join(spans, "_id", "full")
    text = docs.schema["text"]
    joined = docs.join(cuts, docs["doc_id"] == cuts["_id"], "left").drop("_id")
    joined = joined.withColumn("text", F.col("text").cast("string")).withColumn("_cut", F.expr("_gone is not null or _spans is not null"))
    names = [*docs.columns, "_cut"]
    schema = joined.select(*names).schema
    out = joined.mapInArrow(lambda batches: _cut(batches, names), schema)
    changes = {"text": F.col("text").cast(text.dataType)}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[changes.get(c, F.col(c)).alias(c) for c in docs.columns])
