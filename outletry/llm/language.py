"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. A trigram is the product of its letters' vectors, each turned by
its place in the trigram; a text is the sum of its trigrams, and a language the sum of its texts. The
language whose vector has the largest cosine with the text's is the answer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletry.llm.shipping import ship
from outletry.session import stage

DIMENSIONS = 2048
#: Texts of a batch are cut into blocks of about so many characters and rows; both bound memory.
BLOCK_CHARS = 1 << 20
BLOCK_ROWS = 256
_BITS = np.int64(21)
_MASK = np.int64((1 << 21) - 1)
_KNOWN_LIMIT = 8192
_LETTERS: dict[int, np.ndarray] = {}


def _letter(code: int) -> np.ndarray:
    """The signs of a letter, drawn from its own seed, so that all workers agree; 0 is the word edge."""
    if code not in _LETTERS:
        if len(_LETTERS) >= _KNOWN_LIMIT:
            _LETTERS.clear()
        draw = np.random.Generator(np.random.PCG64([97, code])).integers(0, 2, DIMENSIONS, dtype=np.int8)
        _LETTERS[code] = draw * np.int8(2) - np.int8(1)
    return _LETTERS[code]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """One row of signs per trigram code: letter vectors turned by 2, 1 and 0 places and multiplied."""
    out = np.ones((len(grams), DIMENSIONS), dtype=np.int8)
    for turn in (2, 1, 0):
        letters, where = np.unique((grams >> (_BITS * turn)) & _MASK, return_inverse=True)
        out *= np.stack([np.roll(_letter(int(c)), turn) for c in letters])[where]
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, trigram code) of all trigrams: runs of letters, lower-cased, between word edges."""
    joined = "\n".join(texts).lower() + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    kinds, where = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds], dtype=bool)[where]
    lengths = np.array([len(t.lower()) + 1 for t in texts])
    text = np.repeat(np.arange(len(texts)), lengths)
    codes[~letter] = 0
    keep = letter | np.append(True, letter[:-1])  # runs of other characters are one edge
    keep[(np.cumsum(lengths) - lengths)] = True
    keep[np.cumsum(lengths) - 1] = True
    codes, text = codes[keep], text[keep]
    # Each text starts and ends at an edge.
    first = np.append(True, text[1:] != text[:-1])
    before = np.append(0, codes[:-1])
    before[first] = 0
    after = np.append(codes[1:], 0)
    after[np.append(first[1:], True)] = 0
    middle = codes > 0
    return text[middle], ((before << (2 * _BITS)) | (codes << _BITS) | after)[middle]


def _counted(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of neighbouring texts: first row, end row, and per (row, gram) the count."""
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and end - start < BLOCK_ROWS and (end == start or chars + len(texts[end]) <= BLOCK_CHARS):
            chars += len(texts[end])
            end += 1
        parts = []
        if end - start == 1 and len(texts[start]) > BLOCK_CHARS:
            grams, counts = zip(
                *(np.unique(trigrams([x])[1], return_counts=True) for x in _pieces(texts[start])), strict=True
            )
            values, where = np.unique(np.concatenate(grams), return_inverse=True)
            parts.append((np.zeros(len(values), int), values, np.bincount(where, np.concatenate(counts), len(values))))
        else:
            row, gram = trigrams(texts[start:end])
            cuts = np.searchsorted(row, np.arange(end - start + 1))
            for k in range(end - start):
                values, counts = np.unique(gram[cuts[k] : cuts[k + 1]], return_counts=True)
                parts.append((np.full(len(values), k), values, counts))
        yield (start, end, *(np.concatenate(x) for x in zip(*parts, strict=True)))
        start = end


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces that end before a blank where there is one near."""
    at = 0
    while at < len(text):
        to = at + BLOCK_CHARS
        if to < len(text):
            blank = text.rfind(" ", at + 1, to)
            to = blank if blank > 0 else to
        yield text[at:to]
        at = to


def _learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        texts = batch.column(0).to_pylist()
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for start, end, row, gram, count in _counted(texts):
            names = np.array(langs[start:end], dtype=object)[row] if len(row) else np.array([], dtype=object)
            for name in set(langs[start:end]):
                mine = names == name
                values, where = np.unique(gram[mine], return_inverse=True)
                sums.setdefault(name, []).append((values, np.bincount(where, count[mine], len(values))))
        for name, parts in sums.items():
            values, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = np.bincount(where, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(total)],
                names=["lang", "gram", "n"],
            )


def _bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        grams, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
        names = np.array(batch.column(0).to_pylist(), dtype=object)
        for name in set(names):
            mine = names == name
            total = sums.setdefault(name, np.zeros(DIMENSIONS))
            for k in range(0, int(mine.sum()), 1024):
                total += n[mine][k : k + 1024] @ gram_vectors(grams[mine][k : k + 1024]).astype(np.float64)
    for name, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name], pa.string()), pa.array([total.astype(np.int64).tolist()], pa.list_(pa.int64()))],
            names=["lang", "parts"],
        )


def learn_profiles(labelled: DataFrame) -> DataFrame:
    """(lang, place, value): the profile vectors of all languages in ``labelled`` (text, lang).

    Rows with a null text or lang teach nothing. Trigram counts are summed per task and then per
    language, so the shuffle carries each trigram once per task and language.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.where("text is not null and lang is not null").mapInArrow(_learn, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = total.mapInArrow(_bundle, "lang string, parts array<long>")
    return parts.select("lang", F.posexplode("parts").alias("place", "value")).groupBy("lang", "place").agg(
        F.sum("value").alias("value")
    )


def _score(batches: Iterable[pa.RecordBatch], names: list[str], profiles: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Passes the row number on with the best language and its cosine; ties go to the first name."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        best = np.full(len(texts), -1)
        score = np.zeros(len(texts))
        for start, end, row, gram, count in _counted(texts):
            if not len(row) or not len(names):
                continue
            grams, column = np.unique(gram, return_inverse=True)
            vectors = np.zeros((end - start, DIMENSIONS), dtype=np.float32)
            for k in range(0, len(grams), 2048):
                part = (column >= k) & (column < k + 2048)
                table = np.zeros((end - start, min(2048, len(grams) - k)), dtype=np.float32)
                table[row[part], column[part] - k] = count[part]
                vectors += table @ gram_vectors(grams[k : k + 2048]).astype(np.float32)
            norm = np.linalg.norm(vectors, axis=1)
            cosine = (vectors @ profiles.T) / np.where(norm > 0, norm, 1)[:, None]
            some = np.bincount(row, minlength=end - start) > 0
            best[start:end] = np.where(some, cosine.argmax(axis=1), -1)
            score[start:end] = np.where(some, np.clip(cosine.max(axis=1), 0, 1), 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([names[k] if k >= 0 else "und" for k in best], pa.string()),
             pa.array(np.round(score, 6))],
            names=[batch.schema.names[0], "lang_pred", "score"],
        )


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Profiles on the driver: one vector per language name, so their size is that of the label list."""
    table = stage(learn_profiles(labelled), "profiles").toPandas()
    if table.empty:
        return [], np.zeros((0, DIMENSIONS), dtype=np.float32)
    wide = table.pivot(index="lang", columns="place", values="value").sort_index()
    profiles = wide.to_numpy(dtype=np.float64)
    norm = np.linalg.norm(profiles, axis=1, keepdims=True)
    return list(wide.index), (profiles / np.where(norm > 0, norm, 1)).astype(np.float32)


def predict(docs: DataFrame, labelled: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row of ``docs`` (key, text), learned from ``labelled`` (text, lang).

    * A null text and one without a letter are ``und`` with score 0, and so is everything when there
      is no labelled row with a letter.
    * The score is the cosine, not below 0. Equal cosines go to the name that sorts first.
    * Repeated rows are judged one by one; empty tables give empty results; other columns are ignored.
    """
    ship(docs.sparkSession)
    names, profiles = _model(labelled)
    key_type = dict(docs.dtypes)[key]
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _score(batches, names, profiles), f"`{key}` {key_type}, lang_pred string, score double"
    )


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from rows not held out.

    A row without doc_id is predicted like any other, and counts as neither held out nor learnable.
    """
    learnable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    found = predict(docs, docs.where(learnable))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame, least_score: float = 3 / DIMENSIONS**0.5, least_chars: int = 200) -> DataFrame:
    """Rows of ``docs`` whose text is in one of the learned languages, with all their columns.

    Texts that are ``und`` go, and so do texts of ``least_chars`` or more whose cosine is below
    ``least_score``, which is three standard deviations of the cosine of unrelated vectors. A shorter
    text has too few trigrams to tell and stays.
    """
    judged = languages(docs).where("lang_pred <> 'und'").select(F.col("doc_id").alias("_id"), "score")
    judged = judged.groupBy("_id").agg(F.max("score").alias("_score"))
    joined = docs.join(judged, docs["doc_id"].eqNullSafe(judged["_id"]))
    sure = (F.col("_score") >= least_score) | (F.length(docs["text"]) < least_chars)
    return joined.where(sure).select(*[docs[c] for c in docs.columns])
