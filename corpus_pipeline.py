"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, N-best encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm import decontaminate, exact, langid, nbest, shingles
from wardcraft.llm.text import is_held_out, table
from wardcraft.plans.shared import made, materialise, remove, ship_code


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learned from the rows that aren't held out. Those without a letter go."""
    return langid.keep_known(spark, docs, langid.fit(docs.where(~is_held_out(F.col("doc_id")))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of the largest doc_id."""
    return exact.drop_exact_duplicates(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles, or 3 bits): the one of the smallest doc_id; rows without one stay."""
    return shingles.drop_near_copies(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without a doc_id stay."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The segmentation digest of each document that is left; null and empty texts have no pieces."""
    return nbest.encode_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: SQL has neither the language model nor fingerprint components: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again.

    A stage's own tables, and the one that it read, are deleted once its result is written; the last result stays until the process ends.
    Rows with null, empty or letterless texts go in the first stage, repeated rows in the second; rows without a doc_id are kept by the others; an empty table gives no rows.
    """
    ship_code(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = set(made)
        out = materialise(spark, stage(spark, docs, sf_dir), name)
        remove(spark, *[x for x in made if x not in before and x != out._wardcraft_folder], *([docs] if hasattr(docs, "_wardcraft_folder") else []))
        docs = out
    return docs
