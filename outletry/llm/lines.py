"""Line-first cleaning with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: A document is rejected when rules take more than this share of its word characters.
MOST_LOST_PERCENT = 50

# Characters that may end a sentence, quotes and brackets that may follow them, and phrases
# of page furniture.
SENTENCE_END = r"[.!?;:…。！？]"
CLOSING = r"[\"'”’»)\]]"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "enable javascript", "lorem ipsum", "click here", "read more", "sign in", "log in", "subscribe to our",
    "skip to content", "share this", "back to top",
)
#: A line with this many bars, arrows or bullets between its words is navigation.
NAVIGATION_MARKS = r"(?:^|\s)[|»›•·>](?=\s|$)"
LEAST_MARKS = 2
#: Boilerplate phrases condemn only lines that have little besides them.
BOILERPLATE_WORDS = 20


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def line_rules(line: Column) -> dict[str, Column]:
    """The rules of one line; a line that meets any of them is removed, and empty lines pass.

    The cheapest rule comes first, as the others are not tried on a line that meets it, and words are counted only
    in lines with a phrase.
    """
    low = F.lower(line)
    n_words = F.regexp_count(line, F.lit(WORD))
    phrase = low.rlike("|".join(BOILERPLATE))
    return {
        "punctuation": line.rlike(WORD) & ~line.rlike(rf"{SENTENCE_END}{CLOSING}*\s*$"),
        "navigation": F.regexp_count(line, F.lit(NAVIGATION_MARKS)) >= LEAST_MARKS,
        "boilerplate": phrase & (n_words < BOILERPLATE_WORDS),
    }


def cleaned(docs: DataFrame) -> DataFrame:
    """Adds to every row of ``docs`` (text) its base measures, its cleaned text and the verdict.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_removed (lines that
    fail a rule), kept_chars (word characters of the other lines), cleaned_text and kept.

    ``n_repeat_words`` compares windows by a 64-bit hash. Most texts repeat no window, which one hash set
    shows; else windows are sorted by hash, those equal to a neighbour give their places, and the places in
    order give the words they cover.

    * A null text has no words: it fails the base rules, its measures are 0 and its cleaned text is null.
    * An empty line is no failure. Rows are judged one by one, so repeated rows are kept or not alike.
    * Columns of ``docs`` with the names above are replaced; all others stay. Empty tables stay empty.
    """
    own = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_removed",
        "kept_chars", "cleaned_text", "kept",
    ]
    docs = docs.drop(*[c for c in docs.columns if c in own or c.startswith("_l2_")])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"_l2_words": _words(text), "_l2_lines": F.split(text, "\n")})
    rows = rows.withColumns(
        {
            "n_words": F.size("_l2_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, rf"[^{SYMBOLS}]+", "")).cast("long"),
            "_l2_full": F.filter("_l2_lines", lambda x: x.rlike(WORD)),
            "_l2_kept": F.filter("_l2_lines", lambda x: ~_any(line_rules(x))),
            "_l2_hash": F.expr(
                f"""if(size(_l2_words) <= {REPEAT_WINDOW}, cast(array() as array<bigint>),
                    transform(sequence(1, size(_l2_words) - {REPEAT_WINDOW - 1}),
                      i -> xxhash64(slice(_l2_words, i, {REPEAT_WINDOW}))))"""
            ),
        }
    )
    rows = rows.withColumns(
        {
            "n_dup_lines": (F.size("_l2_full") - F.size(F.array_distinct("_l2_full"))).cast("long"),
            "_l2_sorted": F.expr(
                """if(size(array_distinct(_l2_hash)) = size(_l2_hash),
                     cast(array() as array<struct<hash: bigint, place: int>>),
                     array_sort(transform(_l2_hash, (h, i) -> struct(h as hash, i as place))))"""
            ),
        }
    )
    rows = rows.withColumn(
        "_l2_places",
        F.expr(
            """array_sort(transform(filter(_l2_sorted, (x, i) ->
                 (i > 0 and x.hash = element_at(_l2_sorted, greatest(i, 1)).hash)
                 or (i < size(_l2_sorted) - 1 and x.hash = element_at(_l2_sorted, least(i + 2, size(_l2_sorted))).hash)),
               x -> x.place))"""
        ),
    )
    rows = rows.withColumns(
        {
            "n_repeat_words": F.expr(
                f"""if(size(_l2_places) = 0, 0L, {REPEAT_WINDOW} + aggregate(
                      zip_with(slice(_l2_places, 2, size(_l2_places)), _l2_places,
                        (b, a) -> if(b is null, 0, least(b - a, {REPEAT_WINDOW}))),
                      0L, (n, x) -> n + x))"""
            ),
            "n_lines": F.size("_l2_lines").cast("long"),
            "n_removed": (F.size("_l2_lines") - F.size("_l2_kept")).cast("long"),
            "cleaned_text": F.when(F.col("text").isNotNull(), F.array_join("_l2_kept", "\n")),
        }
    )
    rows = rows.withColumn(
        "kept_chars",
        F.length(F.regexp_replace(F.coalesce("cleaned_text", F.lit("")), r"[\x20\x09-\x0D]+", "")).cast("long"),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    lost = 100 * (F.col("word_chars") - F.col("kept_chars")) > MOST_LOST_PERCENT * F.col("word_chars")
    rows = rows.withColumns({"base_failed": base_failed, "kept": ~base_failed & ~lost})
    return rows.drop(*[c for c in rows.columns if c.startswith("_l2_")])


def _any(rules: dict[str, Column]) -> Column:
    first, *others = rules.values()
    for rule in others:
        first = first | rule
    return first
