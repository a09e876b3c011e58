"""Company lists with a header: facts joined with descriptions and ranks, every further column a literal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.literals import value_type

KEYS = ("permalink", "name", "alias1", "alias2", "alias3")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def latest_extra(extra: DataFrame, order: str | None = None) -> DataFrame:
    """(permalink, description, rank): rank 0 where null; of repeated keys the last in ``order`` (file order by default)."""
    last = F.col(order) if order else F.monotonically_increasing_id()
    rows = extra.withColumn("at", last).withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    return rows.groupBy("permalink").agg(F.max_by(F.struct("description", "rank"), "at").alias("x")).select("permalink", "x.description", "x.rank")


def items(main: DataFrame, extra: DataFrame) -> DataFrame:
    """Items of organisations; rows without a permalink go, missing descriptions are empty, popularity is the rank."""
    rows = main.filter(F.col("permalink").isNotNull()).join(extra, "permalink", "left")
    description = F.when(F.col("description") == "nan", "").otherwise(F.coalesce("description", F.lit("")))
    return rows.select(
        F.col("permalink").alias("entity"), F.lit("entity").alias("kind"), description.alias("description"), F.coalesce("rank", F.lit(0.0)).cast("long").alias("popularity"), F.array(F.lit("ORG")).alias("ner_types"),
        F.lit("ORG").alias("ner_type"), F.create_map(F.lit("en"), F.col("name")).alias("labels"), F.create_map().cast("map<string,array<string>>").alias("aliases"), F.array(F.lit("Organization")).alias("explicit_types"),
    )


def literals(main: DataFrame) -> DataFrame:
    """(subject, predicate, datatype, value, pos) of the columns that are not keys; nulls are left out."""
    columns = [c for c in main.columns if c not in KEYS]
    rows = main.filter(F.col("permalink").isNotNull()).select("permalink", *[F.col(c).cast("string").alias(c) for c in columns])
    long = rows.unpivot("permalink", columns, "predicate", "value").filter("value IS NOT NULL")
    return long.select(F.col("permalink").alias("subject"), "predicate", value_type(F.col("value")).alias("datatype"), "value", F.lit(0).alias("pos"))
