"""Incremental runs: new prompt files are picked up, generated once and appended, across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from querent.operators.backend import generate


def generate_incrementally(spark: SparkSession, prompts: str, schema: str, out: str, checkpoint: str, kind: str, keys: list[str], **settings: object) -> StreamingQuery:
    """Structured Streaming over a folder of prompt files (``keys, system, user``).

    Each micro-batch generates what ``out`` lacks and appends it, so a batch that is replayed after a
    failure adds nothing twice; progress lies in the checkpoint folder. Runs until all is read."""

    def step(batch: DataFrame, _: int) -> None:
        # what earlier batches wrote; the folder may not exist yet
        from querent.sources.files import exists

        done = batch.sparkSession.read.parquet(out).select(*keys) if exists(batch.sparkSession, out) else batch.select(*keys).limit(0)
        generate(batch.dropDuplicates(keys), done, kind, keys, **settings).write.mode("append").parquet(out)

    return spark.readStream.schema(schema).json(prompts).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
