"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result
to the shared checkpoint folder as Parquet and reads it back as the next one's docs, so that a lost
executor repeats one stage at most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_duplicates, packing, pii, quality
from tidemark.llm.workspace import Workspace, files_for


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _helper() -> str:
    """The name of a helper column, which no input has."""
    return f"_{uuid.uuid4().hex}"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1; the rest go."""
    model, score = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), _helper()
    return quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(*_columns(docs)).coalesce(files_for(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Documents without words form no group and all stay. Of rows that share a doc_id only those go
    whose own text is a near duplicate of one that stays.
    """
    return near_duplicates.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars follows the new text."""
    count = _helper()
    out = pii.replace_entities(docs, count=count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, its ids (little-endian 16-bit) and its place in the packed
    sequences."""
    return packing.pack(docs, words_kept=250_000)  # earlier stages have filled the workers


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each),
    ("personal data", replace_personal_data),
    ("packing", pack),
]

#: Training a classifier is beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents below ``sf_dir`` that pass all stages."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.stage(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            ws.drop(f"stage-{i - 1}")
    return docs
