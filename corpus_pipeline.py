"""Training-text pipeline over ``documents``; every stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outletry.llm.forest import near_duplicates
from outletry.llm.language import in_known_language
from outletry.llm.leaks import without_leaks
from outletry.llm.packing import pack, token_lengths
from outletry.llm.passages import without_passages
from outletry.llm.queries import table, tokenizer_path
from outletry.session import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the others teach; texts without a letter go."""
    return in_known_language(docs)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, of similarity 0.8 or more."""
    kept = near_duplicates(docs, percent=80).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def unrepeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs and passages that an earlier place has already."""
    return without_passages(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in batches of like length."""
    return pack(token_lengths(docs, tokenizer_path(), per_word=True))


STAGES = [
    ("language", known_language),
    ("near_dedup", unique_documents),
    ("substring_dedup", unrepeated_text),
    ("decontamination", clean_of_benchmarks),
    ("packing", packed),
]

#: Language profiles, cut texts and token lengths have no SQL form; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
