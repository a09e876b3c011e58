"""The corpus pipeline: five stages over ``documents``, each calling one operator, each written and read by the next.

 1. quality      documents that the quality classifier rejects go;
 2. toxicity     documents that the toxicity classifier rejects go;
 3. near_dedup   one document of each near-duplicate class stays;
 4. substrings   words of repeated 35-word windows go from the texts; no document goes, n_chars follows the text;
 5. packing      the rest is tokenised and packed into sequences of 2048.

Stages 1 to 4 return the columns of documents, whatever further columns there are.  Null texts are empty documents.
Repeated rows stay repeated up to stage 3, which keeps one of a class; texts without words are not duplicates there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import near_dedup, packing, quality, substring_dedup, toxicity
from kgspark.llm.bpe import default_path
from kgspark.llm.shared import scratch, shipped, table


def _free_name(docs: DataFrame) -> str:
    """A column name that the documents do not have."""
    return "score" + "_" * (1 + max(map(len, docs.columns)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), _free_name(docs)
    return quality.with_score(docs, model, docs.columns, score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), _free_name(docs)
    return toxicity.with_score(docs, model, docs.columns, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return near_dedup.representatives(docs)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return _measured(substring_dedup.removed(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return packing.pack(docs, default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("toxicity", keep_clean),
    ("near_dedup", keep_one_of_each),
    ("substrings", drop_repeated_windows),
    ("packing", pack),
]

#: Trained classifiers and min-hashes have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
