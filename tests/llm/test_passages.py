"""Benchmark passages and licence notices."""

import random
import re

from outletry.llm import leaks
from outletry.llm.leaks import contaminated, windows_of, without_leaks
from outletry.llm.licences import NONE, UNKNOWN, fit, licences
from outletry.llm.notices import NOTICES

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}


def words_in(text):
    return WORD.findall((text or "").translate(UP))


def brute(text, items):
    words, hit, found = words_in(text), set(), set()
    for item, other in items:
        w = words_in(other)
        size = min(10, len(w))
        runs = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(words) - size + 1 if size else 0):
            if tuple(words[k : k + size]) in runs:
                hit.update(range(k, k + size))
                found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


def cases():
    rng = random.Random(11)
    some = lambda n: [rng.choice(["the", "of", "É1", "x", "y9"]) + rng.choice(["", "a", "b"]) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(1, 40)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "!!"), (33, "One-Two"), (None, "zz yy xx"), (34, "q " * 15)]
    texts = [None, "", "..", "one, TWO", "xx zz yy xx", "q " * 40, "q " * 9, "ÀB one\u00a0two", "w " * 100_000 + "one two"]
    for _ in range(60):
        base = some(rng.randint(0, 60))
        _, passage = rng.choice(items[:25])
        cut = rng.randint(0, len(base))
        part = passage.upper().replace(" ", rng.choice([" ", ", ", "\n"])) if rng.random() < 0.7 else passage[: rng.randint(0, 60)]
        texts.append(" ".join([*base[:cut], part, *base[cut:]]))
    return texts, items


def test_hits_equal_brute_force(spark, make_docs, monkeypatch):
    texts, items = cases()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    docs = make_docs(texts)
    for chars in (4_000_000, 700):
        found = leaks.leaks(docs, bench, automaton_chars=chars).collect()
        assert len(found) == len(texts)
        for r in found:
            n, hit, names = brute(texts[r["doc_id"]], items)
            assert (r["n_words"], r["items"]) == (n, names)
            assert sum(s["end_word"] - s["first_word"] for s in r["spans"]) == hit
            for s in r["spans"]:
                piece = texts[r["doc_id"]][s["first_char"] : s["end_char"]]
                assert words_in(piece) == words_in(texts[r["doc_id"]])[s["first_word"] : s["end_word"]]
    clean = {i for i, t in enumerate(texts) if not brute(t, items)[1]}
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean
    assert {r["doc_id"] for r in contaminated(docs, bench).where("not contaminated").collect()} == clean


def test_leaks_of_odd_tables(spark, make_docs):
    docs = make_docs(["a b", "a b", None], ids=[1, 1, None])
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contaminated(docs, bench.limit(0)).where("contaminated").count() == 0
    assert sorted(r["n_hit"] for r in contaminated(docs, bench).collect()) == [0, 2, 2]
    assert contaminated(docs.limit(0), bench).count() == 0
    assert windows_of("A b!") == [" a b "]


def test_benchmark_items_keep_white_space_outside_ascii_in_words(spark, make_docs):
    blanks = "\u00a0\u0085\u2000\u200a\u2028\u2029\u202f\u3000"
    items = [(k, f"Quel mot{c}? dit-il, un deux trois quatre cinq six{c}sept huit neuf dix") for k, c in enumerate(blanks)]
    items += [(20, "mot\u00a0?"), (21, "\u3000"), (22, "a\u3000b\u2028c")]
    texts = [t for _, t in items] + [f"x {t.upper()}, y" for _, t in items] + ["mot ?", "a b c", " ".join(t for _, t in items)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in leaks.leaks(make_docs(texts), bench).collect():
        n, hit, names = brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["items"]) == (n, names)
        assert sum(s["end_word"] - s["first_word"] for s in r["spans"]) == hit
    assert windows_of("\u00c9t\u00e9\u3000A b") == [" \u00c9t\u00e9\u3000a b "]


def test_licences_are_found_and_others_left(make_docs):
    prose = "The cat sat on the mat and looked at the public library across the road for a while."
    texts = [
        f"{prose}\nReleased under the MIT License.", f"{prose}\nLicensed under the Apache License, Version 2.0.\n{prose}",
        "This work is licensed under the GNU General Public License, version 3.", f"{prose}\nAll rights reserved.",
        "Licensed under CC BY-NC 4.0.", prose, None, "", "He lost the driving license in the city.", f"{prose} " * 2000,
        "permission is hereby granted, free of charge, to any person obtaining a copy", "Released under the MIT License.",
        "Licensed under the Common Development and Distribution License, version 1.1.",
    ]
    rows = licences(make_docs(texts)).collect()
    other = [r for r in rows if r["doc_id"] == 12]
    assert not [r for r in other if r["confirmed"] and r["family"] in ("mit", "apache")]
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in rows if r["confirmed"] and r["doc_id"] != 12}
    assert got == {
        (0, 1): "mit", (1, 1): "apache", (2, 0): "gpl", (3, 1): "proprietary", (4, 0): "cc-by-nc", (10, 0): "mit", (11, 0): "mit"}
    assert all(0 <= r["probability"] <= 1 and 0 <= r["similarity"] <= 1 for r in rows)
    assert licences(make_docs(["x"]).limit(0)).count() == 0


def test_every_document_teaches_what_is_no_licence(make_docs):
    own = [f"zq{i}x" for i in range(260)]
    model = fit(make_docs(["\n".join(f"{w} {tail}" for tail in ("runs far", "sat here", "came late", "looks up", "went home", "fell")) for w in own]))
    weights = model.families.coefficientMatrix.toArray()[model.labels.labels.index(NONE)]
    # A word whose lines are all held for the calibration has no weight; 200 documents would reach 0.77.
    assert sum(weights[model.hashing.indexOf(w)] > 0 for w in own) >= 0.95 * len(own)


def test_paragraphs_without_a_run_of_a_notice_are_classified(make_docs):
    prose = "The cat sat on the mat and looked at the public library across the road for a while."
    rows = licences(make_docs([f"{prose}\nLicense: Apache 2.0", prose, "Apache License"])).collect()
    found = {(r["doc_id"], r["paragraph"]): r for r in rows}
    assert set(found) == {(0, 1), (2, 0)}  # neither shares three words in a row with a notice
    assert (found[0, 1]["family"], found[0, 1]["confirmed"]) == ("apache", True)
    assert found[2, 0]["family"] in ("apache", UNKNOWN) and found[2, 0]["similarity"] == 1.0


def test_similarity_counts_the_pairs_of_words(make_docs):
    texts = ["Released under the terms of the MIT License.", "Released under the MIT License, released under the MIT License."]
    rows = {r["doc_id"]: r for r in licences(make_docs(texts), {f: NOTICES[f] for f in ("mit", "bsd", "gpl")}).collect()}

    def pairs(text):
        words = re.findall(r"[a-z0-9]+", text.lower())
        return set(zip(words, words[1:]))

    for i, text in enumerate(texts):
        among = NOTICES[rows[i]["family"]] if rows[i]["family"] != UNKNOWN else [t for f in ("mit", "bsd", "gpl") for t in NOTICES[f]]
        best = max(len(pairs(n) & pairs(text)) / min(len(pairs(n)), len(pairs(text))) for n in among)
        assert rows[i]["similarity"] == round(best, 6)
