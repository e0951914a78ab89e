"""Line rules and URL rules."""

import random
import re

from pyspark.sql import functions as F

from outletry.llm.lines import cleaned, line_rules
from outletry.llm.urls import RULES, judged, rule_table

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    hit = {k + i for places in seen.values() if len(places) > 1 for k in places for i in range(8)}
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "base_failed": n < 20 or 100 * len(hit) > 30 * n,
    }


def test_base_measures_equal_brute_force(spark, make_docs):
    rng = random.Random(4)
    texts = [None, "", "\n\n", "a b c", "é\u3000ü # *|\u2028x", "a b c d e f g h " * 9, "x y z " * 30_000]
    for _ in range(80):
        words = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 80))]
        cut = rng.randrange(len(words))
        text = " ".join(words + words[cut : cut + rng.randint(0, 30)])
        texts.append(text.replace(" j ", "\n").replace(" i ", "\n\n"))
    rows = {r["doc_id"]: r for r in cleaned(make_docs(texts)).collect()}
    for i, text in enumerate(texts):
        want = brute_base(text)
        assert {k: rows[i][k] for k in want} == want, text


def test_lines_are_removed_first(make_docs):
    good = "This is a whole sentence with quite a few words in it, and it ends as it should."
    other = "Another one follows here, long enough to count as prose and different from all that went before. Yes!"
    texts = [
        "\n".join([good, "Home | News | About | Contact", "no end here", "All rights reserved.", other, ""]),
        "\n".join([good, "word " * 60]),
        f"{good} {other}",
    ]
    docs = make_docs(texts)
    out = cleaned(docs)
    assert set(docs.columns) - {"kept"} <= set(out.columns)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["cleaned_text"] == f"{good}\n{other}\n" and rows[0]["n_removed"] == 3 and rows[0]["kept"]
    assert rows[1]["cleaned_text"] == good and not rows[1]["kept"]
    assert rows[2]["kept"] and rows[2]["cleaned_text"] == texts[2]
    assert cleaned(docs.limit(0)).count() == 0


def brute_rule(url, rules):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [
        (len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


URLS = [
    None, "", "no scheme", "http://", "http://net/", "HTTP://A.NET", "http://a.net/x", "http://x.example.net/en/1?u=/de/",
    "http://example.net/en", "http://example.com/de/", "http://xexample.com/de/", "http://a.b.example.com/de/f/g#h",
    "http://q.org/fr/", "http://q.org/frx", "a://b://c.net/", "http://É.NET/ä", "http://.net/", "http://a..net//en/", "x://y.net?/",
    "http://" + "a." * 3000 + "net/" + "b/" * 3000, "http://example.net/en/\nx",
]


def test_urls_equal_brute_force(spark):
    more = (*RULES, ("net", "/en/1", "allow"), ("b.example.com", "", "allow"), ("org", "/fr", "block"), ("com", "/", "other"), ("", "/", "block"))
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[4:7])], "page_id int, url string, rule string, digest string")
    for rules in (RULES, more, ()):
        table = rule_table(spark, rules) if rules else rule_table(spark).limit(0)
        known = [r for r in rules if r[0] and r[2] in ("allow", "block")]
        rows = judged(pages, table).collect()
        assert len(rows) == len(URLS) + 3
        for r in rows:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_rule(r["url"], known), r["url"]
            assert r["digest"] == "y"
    assert judged(pages.limit(0), rule_table(spark)).count() == 0


def test_words_are_counted_only_for_phrases(spark):
    rules = line_rules(F.col("line"))
    assert next(iter(rules)) == "punctuation" and "regexp_count" not in str(rules["punctuation"])
    lines = ["", " \t", "no end", "An end.", "He said “so.” ", "...", "| a | b |.", "Click here.", "Click here " + "w " * 30 + "."]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(*[c.alias(n) for n, c in rules.items()])
    got = [{n for n, hit in r.asDict().items() if hit} for r in rows.collect()]
    assert got == [set(), set(), {"punctuation"}, set(), set(), set(), {"navigation"}, {"boilerplate"}, set()]
