"""From raw documents to token files: quality rules, near duplicates, benchmark passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the documents of the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontamination, minhash, mixing, quality, token_files
from codeloom.llm.common import stored
from codeloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.kept_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: runs of taken blocks as documents, repeats included."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, described from the files: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_digest(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("token files", write_tokens)]

#: SQL expresses neither the compression bands nor the encoding; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
