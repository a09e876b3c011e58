"""Edges of two columns without a header, tab-separated: instance-of and subclass-of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent); lines with another number of fields have nulls and are left out; repeated edges count once."""
    rows = spark.read.csv(path, sep="\t", schema="child string, parent string", mode="PERMISSIVE")
    return rows.filter("child IS NOT NULL AND parent IS NOT NULL").dropDuplicates()


def write(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    edges.select("child", "parent").write.mode(mode).csv(path, sep="\t")
