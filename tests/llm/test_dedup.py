"""Near-duplicate documents and repeated paragraphs against brute force."""

import random

import numpy as np
import pytest
from test_hashing import plain_shingles

import corpus_pipeline
from outletry.llm import forest, paragraphs, similar
from outletry.llm.components import components
from outletry.llm.forest import near_duplicates
from outletry.llm.paragraphs import repeated_paragraphs, tuned_bands, without_repeats


def words(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.2 else f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, base, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base]


def brute_components(units, percent):
    """Smallest node reachable, over (node, shingle set); empty sets are linked with nothing."""
    top = {n: n for n, _ in units}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, s) in enumerate(units):
        for b, t in units[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {n: find(n) for n, _ in units}


EDGE = [None, "", " \n ", "one", "one two", "ONE two", "a b c d e", "A b c d  e\n", "a b c d e f"]


@pytest.fixture(scope="module")
def family_texts():
    rng = random.Random(5)
    texts = list(EDGE)
    for size, share in ((40, 0.012), (25, 0.03), (6, 0.01), (3, 0.02)):
        base = words(rng, 120)
        texts += [" ".join(edited(rng, base, share)) for _ in range(size)] + [" ".join(base)] * 3
    texts += [" ".join(words(rng, rng.randint(5, 200))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("chunk", [200_000, 600])
def test_components_equal_brute_force(make_docs, family_texts, monkeypatch, chunk):
    monkeypatch.setattr(forest, "DENSE_REGION", 16)
    monkeypatch.setattr(similar, "CHUNK_SHINGLES", chunk)
    monkeypatch.setattr(forest, "similar_components", lambda *a: similar.similar_components(*a, chunk=chunk))
    want = brute_components([(i, set(plain_shingles(t))) for i, t in enumerate(family_texts)], 85)
    rows = near_duplicates(make_docs(family_texts)).collect()
    assert len(rows) == len(family_texts)
    for r in rows:
        assert r["n_shingles"] == len(set(plain_shingles(family_texts[r["doc_id"]])))
        assert r["component_id"] == want[r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_near_duplicates_of_odd_rows(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = make_docs([long, long + " end", "x", "x", None, long], ids=[1, 2, 7, 7, None, None])
    rows = sorted(near_duplicates(docs).collect(), key=str)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in rows), key=str)
    assert got == sorted([(1, 1, True), (2, 1, False), (7, 7, True), (7, 7, True), (None, None, True), (None, 1, False)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_linked_uses_every_pair_outside_the_first_component():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    far = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(base), np.unique(base[:95]), np.unique(far), np.unique(far[3:]), np.unique(far[:20])]
    label = similar.linked(sets, 85)
    assert label[0] == label[1] and label[2] == label[3] and len(set(label)) == 3


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000 + i, 1000) for i in range(1, 300)] + [(5, 5), (None, 3), (7, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.7, 0.8, 0.9):
        bands, rows = tuned_bands(similarity, 2e-5, 64)
        assert (1 - similarity**rows) ** bands <= 2e-5 and bands <= 64


def test_paragraphs_equal_brute_force(make_docs):
    rng = random.Random(8)
    passages = [words(rng, rng.randint(45, 90)) for _ in range(12)]
    texts = [None, "", "short line\n\n"]
    for _ in range(60):
        lines = [" ".join(words(rng, rng.randint(3, 70))) for _ in range(rng.randint(0, 4))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            lines.insert(rng.randint(0, len(lines)), " ".join(edited(rng, p, rng.choice([0, 0, 0.01, 0.04]))))
        texts.append("\n".join(lines))
    texts.append(texts[-1] + "\n" + texts[-1])
    units = [
        ((d, k), set(plain_shingles(line)))
        for d, t in enumerate(texts) for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= 40
    ]
    want = brute_components(units, 80)
    groups = {}
    for node, top in want.items():
        groups.setdefault(top, []).append(node)
    expected = {
        (*node, *top, node != top) for top, nodes in groups.items() if len(nodes) > 1 for node in nodes
    }
    docs = make_docs(texts)
    rows = repeated_paragraphs(docs).collect()
    assert {(r["doc_id"], r["paragraph"], r["first_doc_id"], r["first_paragraph"], r["removed"]) for r in rows} == expected
    assert len(rows) == len(expected)
    gone = {(e[0], e[1]) for e in expected if e[4]}
    kept = without_repeats(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        text = texts[r["doc_id"]]
        if text is not None:
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if (r["doc_id"], k) not in gone)
        assert r["text"] == text and r["n_chars"] == (None if text is None else len(text))


def test_paragraphs_of_odd_rows(make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = make_docs([passage, passage, passage, f"x\n{long}", long, None], ids=[3, 3, None, 5, 9, 11])
    rows = {(r["doc_id"], r["paragraph"], r["first_doc_id"], r["removed"]) for r in repeated_paragraphs(docs).collect()}
    assert rows == {(5, 1, 5, False), (9, 0, 5, True)}
    assert without_repeats(docs).count() == 6
    assert repeated_paragraphs(docs.limit(0)).count() == 0


def test_passages_of_short_lines_are_found(make_docs):
    rng = random.Random(3)
    lines = lambda n, size=9: [" ".join(words(rng, size)) for _ in range(n)]
    p, q, stanza, wrapped = lines(7), lines(8), lines(6), words(rng, 70)
    near = [*q[:3], q[3].rsplit(" ", 1)[0] + " other", *q[4:]]
    cut = [" ".join(wrapped[k : k + 10]) for k in range(0, 70, 10)]
    texts = [
        [*lines(2), *p, *lines(2)], [*lines(1), *p, *lines(1)],  # exact, inside other short lines
        ["", *q, ""], [*lines(1, 60), *near, *lines(1, 60)],  # an edited block
        [*stanza[:3], "", *stanza[3:]], [*lines(1), *stanza, *lines(1)],  # over a blank line
        [" ".join(wrapped)], ["", *cut, ""],  # one long line, wrapped
        ["la la la la la"] * 60,  # overlaps itself
    ]
    docs = make_docs(["\n".join(t) for t in texts])
    left = {r["doc_id"]: r["text"].split("\n") for r in without_repeats(docs).collect()}
    for i in (0, 2, 4, 6):
        assert left[i] == texts[i]
    assert left[1] == [texts[1][0], texts[1][-1]]
    assert left[3] == [texts[3][0], texts[3][-1]]
    assert left[5] == [texts[5][0], texts[5][-1]]
    assert left[7] == ["", ""]
    assert 8 <= len(left[8]) < 60 and set(left[8]) == {"la la la la la"}


def test_forest_follows_the_percent(spark, make_docs):
    for percent in (60, 70, 80, 85, 95):
        depth, bits = forest.tuned_forest(percent / 100)
        p = (1 - percent / 100) / 2
        assert (1 - (percent / 100) ** depth) ** forest.TREES <= 2e-5
        assert bits >= 128 * p + 5 * (128 * p * (1 - p)) ** 0.5
    assert forest.tuned_forest(0.85) == (4, 26)
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = words(rng, 104)
        texts += [" ".join(base), " ".join([*base[:92], *words(rng, 12)])]  # J about 88 / 112 = 0.79
        texts.append(" ".join([*base[:94], *words(rng, 10)]))  # J about 90 / 110 = 0.82
    units = [(i, set(plain_shingles(t))) for i, t in enumerate(texts)]
    want = {percent: brute_components(units, percent) for percent in (60, 80, 85)}
    assert want[80] != want[85]
    for percent in (60, 80):
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(texts), percent).collect()}
        assert got == want[percent]
    kept = {r["doc_id"] for r in corpus_pipeline.unique_documents(spark, make_docs(texts), "").collect()}
    assert kept == {i for i in want[80] if want[80][i] == i}


@pytest.mark.parametrize("size", [50, 300])
def test_partners_far_apart_in_a_bucket_stay_candidates(spark, size, monkeypatch):
    """One bucket, small or large, of unlike sketches with partners between which many others sort."""
    monkeypatch.setattr(paragraphs, "BUCKET_CHUNK", 64, raising=False)
    rng = random.Random(8)
    bits = [rng.getrandbits(63) for _ in range(size)]
    bits += [b ^ (1 << 62) ^ 5 for b in bits[10:20]]
    rows = [(i, b, [1]) for i, b in enumerate(bits)]
    got = paragraphs.candidates(spark.createDataFrame(rows, "node long, bits long, bands array<long>")).collect()
    root = list(range(len(bits)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        assert (bits[r["a"]] ^ bits[r["b"]]).bit_count() <= paragraphs.MOST_BITS
        root[top(r["a"])] = top(r["b"])
    close = [(i, j) for j in range(len(bits)) for i in range(j) if (bits[i] ^ bits[j]).bit_count() <= paragraphs.MOST_BITS]
    assert len(close) >= 10
    assert all(top(i) == top(j) for i, j in close)
