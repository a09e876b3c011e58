"""A dump that arrives in files, as a stream: what has been read is kept by the checkpoint, so a stopped run goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kgspark.sources import dump


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, files_at_once: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Files of dump lines under ``folder`` to ``out``/{items,edges,literals,type_edges}/batch=N.

    A batch that is run again after a failure overwrites its own folders, so every line counts once.
    """

    def store(lines: DataFrame, batch: int) -> None:
        entities = dump.parsed(lines).persist()
        try:
            for name, table in (("items", dump.items(entities)), ("edges", dump.edges(entities)), ("literals", dump.literals(entities)), ("type_edges", dump.type_edges(entities))):
                table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
        finally:
            entities.unpersist()

    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)
    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
