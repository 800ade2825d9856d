"""A training-data pipeline over documents: STAGES, run() and ORACLE_SQL.

Each stage takes all rows that the one before kept, read back from Parquet: language ID, n-gram Jaccard join, benchmark
decontamination, mixing to target weights, token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from attesta.llm.common import cut, table
from attesta.llm.decontaminate import decontaminated
from attesta.llm.language import identified, kept
from attesta.llm.mixing import in_mixed_order
from attesta.llm.ngram_join import ngram_components
from attesta.llm.token_files import token_files
from attesta.llm.tokens import public_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that language ID rejects go.

    Null and empty texts, and texts without letters, are rejected; a null lang is no declaration, a null source a host like others. Ties
    go to the language first in the alphabet. Repeated rows stay or go together; a null id stays. Extra columns are left behind.
    """
    return identified(docs).where(kept()).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies (word 5-grams, Jaccard 0.8).

    Null and empty texts are copies of nothing and stay, as do all rows of a null id. Rows repeated with their id all stay where it stays. Extra
    columns are left behind, whatever their names.
    """
    groups = ngram_components(docs, k=5, percent=80).where("component_id is null or component_id = doc_id").select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(groups, docs["doc_id"].eqNullSafe(groups["stays"]), "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts, and null ids, stay unless their text holds one; repeated rows stay or go together. Without items all stay. Extra columns are left behind.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture.

    Nothing goes: a null source is a source of its own, a null id an id, rows that repeat both share a place. Extra columns are left behind.
    """
    return in_mixed_order(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files in the order in which the mixture was written, and where each document lies in them.

    One row a row: a null text counts as empty and has the end id alone, a null id is reported as null. Docs that are not read from files are taken by ascending id.
    """
    try:
        order = [F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.row_index").alias("row")]
        docs = docs.select(*COLUMNS, *order)
    except AnalysisException:  # not read from files
        return token_files(docs, public_tokenizer()).select("doc_id", "start", "n_tokens", "ids_crc32")
    return token_files(docs, public_tokenizer(), order=[F.col("file"), F.col("row")]).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, start, n_tokens, ids_crc32."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


#: The language posterior, the schedule and the byte-level BPE have no SQL form.
ORACLE_SQL = None
