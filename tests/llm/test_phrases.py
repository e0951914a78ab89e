"""Phrase collocations against a brute force, with hot prefixes split and odd inputs."""

import re
from collections import Counter

import pytest

from outletry.llm import phrases


def brute(rows, least=10, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for d in (1, 2, 3):
                    if i + d <= len(w):
                        counts.setdefault(lang, Counter())[tuple(w[i : i + d])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        rows_ = []
        for p, a in cands.items():
            if len(p) == 2 and any(
                len(q) == 3 and (q[:2] == p or q[1:] == p) and 100 * b >= 50 * a for q, b in cands.items()
            ):
                continue
            cuts = [(a * a * 1_000_000 // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            rows_.append((lang, " ".join(p), a, l, r, totals[lang], score))
        rows_.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], k + 1, *x[1:]) for k, x in enumerate(rows_[:top])]
    return sorted(out)


TEXTS = [
    "the cat sat. the cat sat on the mat; The Cat sat\tdown!",
    None,
    "",
    "   .,;  ",
    "naïve café au lait, naïve café au lait. naïve café",
    "x y z x y z x y z x y z",
]


@pytest.mark.parametrize("budget", [1, 3, 1_000_000])
def test_collocations_equal_brute_force(make_docs, budget):
    texts = TEXTS * 6 + ["the cat sat"] * 5  # repeated rows count each time
    langs = [None if i % 7 == 0 else "en" for i in range(len(texts))]
    docs = make_docs(texts, langs=langs).withColumn("words", phrases.F.lit("clash")).withColumn("leaf", phrases.F.lit(1))
    got = phrases.collocations(docs, top=5, per_group=budget).collect()
    want = brute(list(zip(texts, langs, strict=True)), top=5)
    assert sorted(tuple(r) for r in got) == want
    assert want  # the fixture has candidates


def test_scores_are_exact_past_64_bits(spark):
    a, l, r = 3_037_000_499, 3_037_000_500, 3_037_000_501  # a * a * 1e6 passes 64 bits
    row = spark.range(1).selectExpr(f"{a}L AS a", f"{l}L AS l", f"{r}L AS r").select(phrases._score("a", "l", "r")).first()
    assert row[0] == a * a * 1_000_000 // (l * r)


def test_collocations_of_an_empty_table(make_docs):
    assert phrases.collocations(make_docs([]).limit(0)).count() == 0
