"""The corpus pipeline: quality rules, SimHash near-dedup, removal of personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame that is written as Parquet and read again as
the next stage's ``docs``. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, pii, quality, simhash
from tidemark.llm.common import free_name, saved
from tidemark.llm.queries import tokenizer_path


#: Near duplicates: words of a shingle, the similarity of a link, fingerprints, and the probability that a link is missed.
NEAR = {"shingle": 5, "least": 0.8, "count": 12, "missed": 0.03}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The references are those of the documents labelled good."""
    verdict = free_name(docs, "quality")
    references = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(docs, docs.columns, references, out_col=verdict)
    return judged.where(F.col(verdict)["kept"]).drop(verdict)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id (of repeated rows, one). Near
    duplicates have a Jaccard similarity of 0.8 or more by five-word shingles, or are joined by such."""
    return simhash.deduplicated(docs, **NEAR)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to placeholders; ``n_chars`` follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its ids and its place in a sequence."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: SimHash and byte-pair encoding can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
