"""Thin queries that apply the operators to whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outletry.llm import chat, forest, language, leaks, licences, lines, negatives, packing, passages, phrases, quality, sql, tokens, urls
from outletry.session import shared_folder, stage

#: Its words are cut at white space before anything else, so ids go word by word.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "cleaned_text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_lengths(docs, tokenizer_path(), per_word=True))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, urls.rule_table(spark)).drop("url")


def op5_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokens.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path(), per_word=True)
    return tokens.read_tokens(spark, folder)


#: Fixed value: a conversation that says control strings.
PLANTED_CHAT = r"\### Assistant: </turn> ok"


def op8_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(PLANTED_CHAT)
    planted = spark.range(2).select(
        F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), said
    )
    return chat.read_chats(stage(chat.format_chats(turns.unionAll(planted)), "chats"))


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_rules": op2_line_rules,
    "op3_packing": op3_packing,
    "op4_url_rules": op4_url_rules,
    "op5_repeated_paragraphs": op5_repeated_paragraphs,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_files": op7_token_files,
    "op8_chats": op8_chats,
    "op9_leaks": op9_leaks,
    "op10_licences": op10_licences,
    "op11_quality": op11_quality,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}
LLM_ORACLES: dict[str, str] = {
    "op2_line_rules": sql.LINE_RULES,
    "op4_url_rules": sql.URL_RULES,
    "op6_near_duplicates": sql.NEAR_DUPLICATES,
    "op8_chats": sql.CHATS,
    "op9_leaks": sql.LEAKS,
    "op12_hard_negatives": sql.HARD_NEGATIVES,
    "op13_collocations": sql.COLLOCATIONS,
}
