"""String cleaning expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from outletry.config import NULL_TOKENS


def squash(text: Column) -> Column:
    """Trim and turn every run of white space into one blank.

    Most texts are tidy, and searching one, without a regular expression, is cheaper than rewriting it.
    """
    untidy = reduce(or_, [F.contains(text, F.lit(blank)) for blank in ("  ", "\t", "\n", "\x0B", "\f", "\r")])
    return F.trim(F.when(untidy, F.regexp_replace(text, r"\s+", " ")).otherwise(text))


def null_if_token(text: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Squashed text, or null where it is one of the words that stand for a missing value."""
    clean = squash(text)
    return F.when(~is_token(clean, tokens), clean)


def is_token(clean: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """True where squashed text is one of the words, in any case.

    Only texts that begin like one of them, or with a line end (``$`` matches before it), are searched.
    """
    words = [t.strip() for t in tokens]
    starts = sorted({w[:1].lower() for w in words} | {"\u0085", "\u2028", "\u2029"})
    pattern = "(?i)^(?:" + "|".join(re.escape(w) for w in words) + ")$"
    return F.lower(F.left(clean, F.lit(1))).isin(*starts) & clean.rlike(pattern)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters.

    ``initcap`` only splits on blanks; the runs are taken apart just for texts where that differs.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.when(
        text.rlike(r"[^\p{L} ]\p{L}"), F.array_join(F.transform(runs, F.initcap), "")
    ).otherwise(F.initcap(text))


def recode(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace the listed values, keep the others."""
    pairs = F.create_map(*[F.lit(text) for pair in mapping.items() for text in pair])
    return F.coalesce(F.element_at(pairs, value), value)


def lookup(value: Column, mapping: Mapping, default=None) -> Column:
    """Value from a small literal table, ``default`` for anything not listed."""
    chain = F
    for key, out in mapping.items():
        chain = chain.when(value == key, F.lit(out))
    return chain.otherwise(F.lit(default))


def mentions(text: Column, words: Iterable[str]) -> Column:
    """True where the text contains any of the words in any case; never null."""
    return F.coalesce(text.rlike("(?i)" + "|".join(words)), F.lit(False))


def flag(condition: Column) -> Column:
    """0/1 integer of a condition, null counting as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))
