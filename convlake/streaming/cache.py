"""The append-only judgement cache as a stream: each micro-batch adds the last entry of every key that it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.judging import last_entries
from ..schemas import JUDGEMENT


def append_judgements(spark: SparkSession, source: str, cache: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append new JSON-lines judgements under ``source`` to the Parquet ``cache``; malformed lines are dropped.

    A batch is written to a folder named by its number, so a batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        last_entries(batch.where("cache_key is not null")).write.mode("overwrite").parquet(f"{cache}/batch={number}")

    stream = spark.readStream.schema(JUDGEMENT).option("mode", "DROPMALFORMED").json(source)
    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
