"""The corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, tokens.

STAGES are applied in order; each gets the documents that its predecessor kept, as written
and reread Parquet. All but the last return the columns they get, whatever their names; the
last gives token ids in place of texts. SQL can express neither the secret lexing nor the
encoding, so there is no ORACLE_SQL; tests hold run() against a brute-force version.

Each stage takes nulls in any column, empty, blank and very long texts, repeated rows, several
texts of one id, extra columns and empty tables; its docstring says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, ngram_join, quality, queries, secrets, sentencepiece
from codeloom.llm.common import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep.

    Null, empty and blank texts have no words, so they go; long texts are judged whole; each of
    several equal rows is kept or goes as the others, and counts for its host; a null source is a
    host of its own; without rows there is no result.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of least doc_id, a null id last.

    Repeated rows become one; texts without words (null, empty, blank) are no copies of each
    other unless their ids are equal too; texts of one id that differ are judged apart; long
    texts are compared whole; without rows there is no result.
    """
    return ngram_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (benchmark.parquet in sf_dir).

    Each row is judged by its own text, whatever id it has or shares; null and empty texts, and
    items of fewer than five words, hold nothing, so these documents stay; repeated rows stay
    repeated; long texts are searched whole; without items all documents stay.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows.

    Null texts stay null, empty ones empty; long texts are scanned whole; repeated rows stay
    repeated and get equal results; ids do not matter; without rows there is no result.
    """
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids: doc_id, lang, source, ids and their number; other columns go.

    Null and empty texts have no ids; long texts are encoded whole; repeated rows stay repeated;
    null ids, languages and sources pass through; without rows there is no result.
    """
    encoded = sentencepiece.encode(docs.select("doc_id", "lang", "source", "text"), queries.tokenizer_path("piece_bpe_32k.model"))
    return encoded.withColumn("n_ids", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("secret_scans", secret_scans),
    ("sentencepiece", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
