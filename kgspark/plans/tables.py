"""Intermediate tables: written once to the folder that driver and executors share, read back without their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kgspark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Survives lost executors; removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kgspark/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input files whose rows one task groups.
GROUPED_AT_ONCE = 8 << 20


def shares(df: DataFrame, at_once: int) -> int:
    """How many parts hold ``at_once`` bytes of the input files each."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(1, -(-sum(x for x in sizes if x < 1 << 60) // at_once))  # larger ones stand for an unknown size


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Before rows are grouped by ``keys`` or more: so many parts that a task's share does not grow with the input files.

    Grouping needs no further shuffle then.  Where the session's number of shuffle partitions is enough, nothing is done.
    """
    parts = shares(df, GROUPED_AT_ONCE)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shipped(df: DataFrame) -> DataFrame:
    """Sends this package to the Python workers once a session, so that they need not have it installed."""
    context = df.sparkSession.sparkContext
    if getattr(context, "_kgspark_sent", None) is None:
        folder, top = tempfile.mkdtemp(prefix="kgspark-"), Path(__file__).resolve().parents[2]
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it lives
        with zipfile.ZipFile(f"{folder}/kgspark-core.zip", "w") as z:
            for path in sorted((top / "kgspark").rglob("*.py")):
                z.write(path, path.relative_to(top))
        context.addPyFile(f"{folder}/kgspark-core.zip")
        context._kgspark_sent = True
    return df
