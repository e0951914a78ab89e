"""Benchmark passages in documents, found by an Aho-Corasick automaton over normalised text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletry.llm.shipping import ship

WINDOW = 10
#: Characters of windows in one automaton, about forty times that in memory. A larger benchmark is
#: split over several automata, each of which scans all texts.
AUTOMATON_CHARS = 4_000_000

#: Words are runs of 0-9, A-Z, a-z and whatever is not ASCII; A-Z count as a-z.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def normalised(text: str | None) -> str:
    """Words with one blank before and after each."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else ""


def windows_of(text: str | None, size: int = WINDOW) -> list[str]:
    """All runs of ``size`` words; a shorter text, if it has words, is one run."""
    plain = normalised(text)
    if not plain:
        return []
    words = plain[1:-1].split(" ")  # white space outside ASCII belongs to words
    return [f" {' '.join(words[k : k + size])} " for k in range(max(1, len(words) - size + 1))]


def _windows(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        pairs = [(i, w) for i, t in zip(ids, texts, strict=True) for w in windows_of(t, size)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())],
            names=["item_id", "window"],
        )


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(windows: list[tuple[str, tuple[str, ...]]]) -> ahocorasick.Automaton:
    """The automaton of these windows, built once per worker."""
    name = hashlib.sha256(repr(windows).encode("utf-8", "surrogatepass")).hexdigest()
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        built = ahocorasick.Automaton()
        for window, items in windows:
            built.add_word(window, (window.count(" ") - 1, items))
        if len(windows):
            built.make_automaton()
        _AUTOMATA[name] = built
    return _AUTOMATA[name]


def scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, runs of hit words as [first, end) word numbers, items) of one text."""
    plain = normalised(text)
    if not plain:
        return 0, [], set()
    n_words = plain.count(" ") - 1
    if not len(automaton):
        return n_words, [], set()
    ends, widths, items = [], [], set()
    for end, (width, names) in automaton.iter(plain):
        ends.append(end)
        widths.append(width)
        items.update(names)
    if not ends:
        return n_words, [], set()
    blanks = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32)
    last = np.searchsorted(blanks, ends)
    hit = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(hit, last - np.array(widths), 1)
    np.add.at(hit, last, -1)
    inside = np.concatenate([[False], np.cumsum(hit)[:-1] > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return n_words, list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), items


_FOUND = (
    "doc_id long, text_key binary, n_words long, items array<string>, "
    "spans array<struct<first_word: long, end_word: long, first_char: long, end_char: long>>"
)


def _find(batches: Iterable[pa.RecordBatch], windows) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(windows.value)
    spans_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "first_char", "end_char")]))
    for batch in batches:
        n_words, items, spans, keys = [], [], [], []
        for text in batch.column(1).to_pylist():
            keys.append(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest())
            n, runs, found = scan(text, automaton)
            n_words.append(n)
            items.append(sorted(found))
            if runs:
                places = [m.span() for m in WORD.finditer(text)]
                runs = [
                    {"first_word": a, "end_word": b, "first_char": places[a][0], "end_char": places[b - 1][1]}
                    for a, b in runs
                ]
            spans.append(runs)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())),
             pa.array(spans, spans_type)],
            names=["doc_id", "text_key", "n_words", "items", "spans"],
        )


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, items): every distinct window of words of ``benchmark`` (item_id, text) and its items.

    A null item_id marks words as hit and is no item; null texts and texts without words have no window.
    """
    ship(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    pairs = rows.mapInArrow(lambda b: _windows(b, size), "item_id string, window string").distinct()
    return pairs.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """doc_id, n_words, items and spans of every row of ``docs``.

    ``items`` are the sorted ids (as text) of benchmark items with a window in the text, ``spans`` the
    maximal runs of words inside occurring windows, as word numbers and as offsets in the original.

    * Null, empty and wordless texts have no words and no spans. Rows are judged one by one, repeated
      ones too; an empty benchmark hits nothing; extra columns are ignored.
    * Windows of one automaton go to the workers as a broadcast of at most ``automaton_chars``
      characters; a larger benchmark takes several scans of the texts, whose spans are merged.
    """
    spark = docs.sparkSession
    ship(spark)
    windows = benchmark_windows(benchmark, size)
    total = windows.agg(F.sum(F.length("window")).alias("n")).first()["n"] or 0
    parts = -(-total // automaton_chars) or 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(part: int) -> DataFrame:
        mine = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast([(r["window"], tuple(r["items"])) for r in mine.orderBy("window").toLocalIterator()])
        return rows.mapInArrow(lambda batches: _find(batches, held), _FOUND)

    if parts == 1:
        return one(0).drop("text_key")
    return _merged([one(k) for k in range(parts)])


def _merged(scans: list[DataFrame]) -> DataFrame:
    """Scans with different windows, as one row per document: runs of hit words are joined again."""
    found = scans[0]
    for other in scans[1:]:
        found = found.unionAll(other)
    # Equal rows of docs scan equally, so each scan has every row as often as docs.
    held = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        (F.count("*") / len(scans)).cast("int").alias("times"),
    )
    joined = """aggregate(spans, cast(array() as array<struct<first_word: bigint, end_word: bigint,
        first_char: bigint, end_char: bigint>>), (done, x) ->
        if(size(done) > 0 and done[size(done) - 1].end_word >= x.first_word,
           concat(slice(done, 1, size(done) - 1), array(named_struct(
             'first_word', done[size(done) - 1].first_word,
             'end_word', greatest(done[size(done) - 1].end_word, x.end_word),
             'first_char', done[size(done) - 1].first_char,
             'end_char', greatest(done[size(done) - 1].end_char, x.end_char)))),
           concat(done, array(x))))"""
    return held.select(
        "doc_id", "n_words", F.sort_array("items").alias("items"), F.expr(joined).alias("spans"),
        F.explode(F.expr("sequence(1, times)")),
    ).drop("col")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``leaks``: hit words, items and their sha256 per document."""
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end_word - x.first_word)")
    return leaks(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a benchmark passage, with all their columns.

    Rows that share a doc_id are one document and go together.
    """
    dirty = contaminated(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_dirty")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["_dirty"]), "left_anti")
