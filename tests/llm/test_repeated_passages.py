"""Passages repeated inside longer lines against brute force."""

import random

from outletry.llm import passages
from outletry.llm.passages import WINDOW, repeated_passages, repeats, without_passages
from outletry.session import stage


def brute(texts):
    """Words of later and of first occurrences, by document: sets of word numbers."""
    later, firsts = {}, {}
    split = [(t or "").lower().split() for t in texts]
    places = {}
    for d, w in enumerate(split):
        for k in range(len(w) - WINDOW + 1):
            places.setdefault(tuple(w[k : k + WINDOW]), []).append((d, k))
    for at in places.values():
        d0, k0 = at[0]
        others = [(d, k) for d, k in at if d != d0 or k >= k0 + WINDOW]
        for d, k in others:
            later.setdefault(d, set()).update(range(k, k + WINDOW))
        if others:
            firsts.setdefault(d0, set()).update(range(k0, k0 + WINDOW))
    return later, firsts


def cases():
    rng = random.Random(5)
    some = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(n)]
    passages_ = [some(rng.randint(WINDOW - 1, 90)) for _ in range(10)]
    texts = [None, "", " ".join(some(WINDOW - 1)), "q " * 200, "Q\n" * 30 + " q" * 30]
    for _ in range(40):
        words = some(rng.randint(0, 150))
        for p in rng.sample(passages_, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = [x.upper() for x in p] if rng.random() < 0.3 else p
        texts.append("".join(w + rng.choice([" "] * 30 + ["\n", "  "]) for w in words))
    return texts


def spans(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).update(range(r["from_word"], r["from_word"] + r["n_words"]))
    return out


def test_passages_equal_brute_force(make_docs):
    texts = cases()
    later, firsts = brute(texts)
    rows = repeated_passages(make_docs(texts)).collect()
    assert spans(r for r in rows if r["removed"]) == later
    assert spans(r for r in rows if not r["removed"]) == firsts
    for r in rows:
        text = texts[r["doc_id"]]
        lines = [k for k, line in enumerate(text.split("\n")) for _ in line.split()]
        end = r["from_word"] + r["n_words"] - 1
        assert (r["paragraph"], r["n_lines"]) == (lines[r["from_word"]], lines[end] - lines[r["from_word"]] + 1)
        assert (r["first_doc_id"], r["first_paragraph"]) <= (r["doc_id"], r["paragraph"])


def test_a_passage_inside_longer_lines_is_found_and_cut(make_docs):
    passage = " ".join(f"p{i}" for i in range(55))
    other = lambda k, n: " ".join(f"{k}x{i}" for i in range(n))
    line = " ".join(f"l{i}" for i in range(60))
    texts = [
        f"{other('a', 90)} {passage} {other('b', 200)}\n{line}",
        f"{other('c', 150)} {passage.upper()}  é {other('d', 80)}\nend",
        f"{line}\nx\n{other('e', 70)}\n{passage}",
        other("f", 300),
    ]
    docs = make_docs(texts)
    rows = repeats(docs).collect()
    found = {(r["doc_id"], r["paragraph"], r["first_doc_id"], r["first_paragraph"], r["removed"]) for r in rows}
    assert found == {(0, 0, 0, 0, False), (1, 0, 0, 0, True), (2, 3, 0, 0, True), (0, 1, 0, 1, False), (2, 0, 0, 1, True)}
    kept = without_passages(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    want = [texts[0], f"{other('c', 150)} é {other('d', 80)}\nend", f"x\n{other('e', 70)}", texts[3]]
    assert got == {k: (t, len(t)) for k, t in enumerate(want)}


def test_passages_of_odd_rows(make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = make_docs([f"a {passage}", f"a {passage}", passage, f"b {passage}", None], ids=[3, 3, None, 5, 7])
    rows = repeated_passages(docs).collect()
    assert {(r["doc_id"], r["from_word"], r["n_words"], r["first_doc_id"], r["removed"]) for r in rows} == {
        (3, 1, 60, 3, False), (5, 1, 60, 3, True)}
    assert len(rows) == 2
    gone = docs.sparkSession.createDataFrame([(5, 0)], "doc_id long, paragraph long")
    assert repeated_passages(docs, gone).count() == 0
    assert repeated_passages(docs.limit(0)).count() == 0
    assert without_passages(docs).count() == 5
    assert without_passages(docs.limit(0)).count() == 0


def test_partial_copies_and_loops_equal_brute_force(make_docs):
    """Runs of a key that differ by copy: cut at other words, looping inside, beside a line already taken out."""
    rng = random.Random(8)
    long = [f"w{i}" for i in range(300)]
    loop = [f"c{i % 30}" for i in range(130)]
    texts = []
    for k in range(30):
        a = rng.randint(0, 200)
        own = [f"x{k}y{i}" for i in range(rng.randint(0, 30))]
        texts.append(" ".join(own + long[a : a + rng.randint(38, 100)] + own + loop[rng.randint(0, 60) :]))
    texts += [" ".join(long), " ".join(["z"] + long + ["z"] + long[:60])]
    later, firsts = brute(texts)
    rows = repeated_passages(make_docs(texts)).collect()
    assert spans(r for r in rows if r["removed"]) == later
    assert spans(r for r in rows if not r["removed"]) == firsts


def test_copies_are_compared_by_run_not_by_window(make_docs, monkeypatch):
    """Inside a copied passage the windows that share a key travel as one row."""
    seen = {}

    def kept(df, name="stage", *rest):
        seen[name] = stage(df, name, *rest)
        return seen[name]

    monkeypatch.setattr(passages, "stage", kept)
    copy = " ".join(f"p{i}" for i in range(1000))
    rows = repeated_passages(make_docs([f"a{k} {copy} b{k}" for k in range(4)])).collect()
    assert {(r["doc_id"], r["from_word"], r["n_words"]) for r in rows} == {(k, 1, 1000) for k in range(4)}
    assert seen["units"].count() < 4 * (1000 - WINDOW) / 4
