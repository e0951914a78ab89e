"""Language profiles: the vector algebra, held-out accuracy and odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from outletry.llm import language
from outletry.llm.language import gram_vectors, in_known_language, languages, trigrams
from outletry.llm.queries import op1_language_id, table


def test_trigrams_equal_plain_python(monkeypatch):
    texts = ["Ab, c", "", "1!é\nx", "a" * 7, "\u4f60\u597d world"]
    row, gram = trigrams(texts)
    got = Counter((int(r), *(int(g) >> (21 * k) & ((1 << 21) - 1) for k in (2, 1, 0))) for r, g in zip(row, gram))
    want = Counter()
    for i, t in enumerate(texts):
        run = [0] + [ord(c) if c.isalpha() else 0 for c in t.lower()] + [0]
        for k in range(1, len(run) - 1):
            if run[k]:
                want[(i, *run[k - 1 : k + 2])] += 1
    assert got == want


def test_vectors_are_bound_from_turned_letters():
    a, b, c = (language._letter(ord(x)) for x in "abc")
    code = (ord("a") << 42) | (ord("b") << 21) | ord("c")
    assert (gram_vectors(np.array([code]))[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()
    assert abs(int(a.astype(int) @ b.astype(int))) < 5 * language.DIMENSIONS**0.5


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    long = [r for r in held if len(r["text"]) >= 100]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(r["lang"] == r["lang_pred"] for r in long)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:3]
    rows = [(i, "the cat and the dog", "en") for i in range(1000, 1020)] + [(i, "zzz qqq xxx", "xx") for i in ids]
    got = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in got.collect()} == {"en"}


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_odd_rows(make_docs, monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK_CHARS", block)
    texts = [None, "", "12 !?", "the cat sat on the mat", "der Hund und die Katze", "the " * 100_000, "the cat sat on the mat"]
    ids = [4, 5, 6, 1, 3, None, 1]
    langs = [None, "en", "en", "en", "de", "en", None]
    docs = make_docs(texts, ids, langs)
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"]) for r in languages(docs).collect()), key=str)
    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 3, 4, 5, 6)}
    assert [g for g in got if g[0] in (4, 5, 6)] == [(i, out[i], "und") for i in (4, 5, 6)]
    assert all(g[1] == out.get(g[0], False) for g in got) and len(got) == 7
    kept = in_known_language(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "3", "None"]
    assert languages(docs.limit(0)).count() == 0
    unlabelled = make_docs(["the cat"], [1], [None])
    assert [(r["lang_pred"], r["score"]) for r in languages(unlabelled).collect()] == [("und", 0.0)]
