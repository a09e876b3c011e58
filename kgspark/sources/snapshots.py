"""Snapshots of a graph: ``<root>/kg=<name>/snapshot=<yyyymmdd>/<table>``, one marked whole by its ``_SUCCESS`` files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("items", "edges", "literals", "type_edges", "closure", "names", "postings", "vocabulary")
#: The table that is written after all others.
LAST = "vocabulary"


def resolved(databases: DataFrame) -> DataFrame:
    """(kg, name, date) of (name, status): the newest by the ddmmyyyy at a name's end; those under construction are hidden.

    A name without a date counts as today's."""
    parts = databases.filter(F.coalesce("status", F.lit("")) != "DOING").select("name", F.regexp_replace("name", "[^A-Za-z]", "").alias("kg"), F.regexp_replace("name", r"\D", "").alias("digits"))
    date = F.when(F.col("digits") == "", F.current_date()).otherwise(F.try_to_timestamp("digits", F.lit("ddMMyyyy")).cast("date"))
    return parts.withColumn("date", date).filter("date IS NOT NULL").groupBy("kg").agg(F.max_by("name", F.struct("date", "name")).alias("name"), F.max("date").alias("date"))


def index_name(name: Column) -> Column:
    """A database's name without the digits at its end."""
    return F.regexp_replace(name, r"\d+$", "")


def write(tables: dict[str, DataFrame], root: str, kg: str, date: str) -> None:
    for name, df in tables.items():
        sort = {"postings": "term", "vocabulary": "term", "edges": "subject", "literals": "subject"}.get(name, df.columns[0])
        df.repartitionByRange(sort).sortWithinPartitions(sort).write.mode("overwrite").parquet(f"{root}/kg={kg}/snapshot={date}/{name}")


def newest(spark: SparkSession, root: str, kg: str, table: str, before: str | None = None) -> str:
    """The date of the newest snapshot, of those before a date if one is given, that has a whole table of that name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/kg={kg}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    whole = [s for s in found if s.startswith("snapshot=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/kg={kg}/{s}/{table}/_SUCCESS"))]
    whole = [s for s in whole if not before or s < f"snapshot={before}"]
    if not whole:
        raise ValueError(f"no snapshot of {kg} has {table}")
    return whole[-1].removeprefix("snapshot=")


def read(spark: SparkSession, root: str, kg: str, table: str, date: str | None = None) -> DataFrame:
    """A table of a snapshot, the newest if no date is given; column statistics of the sorted files prune scans."""
    return spark.read.parquet(f"{root}/kg={kg}/snapshot={date or newest(spark, root, kg, table)}/{table}")
