"""Streaming intake: new upload records -> validate -> score -> results log.

Each micro-batch is processed with ``foreachBatch`` and written to the
results log under ``intake_id = <streaming query id>``, ``run_id = <batch id>``
with dynamic partition overwrite. The query id lives in the checkpoint: it
survives restarts, and a new or reset checkpoint has another one. So a replayed
batch replaces exactly its own partition, and two intakes that write into one
log, or one that starts afresh, never replace each other's rows.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.writers import write_results


def start_intake(spark: SparkSession, source_dir: str, schema: T.StructType,
                 process: Callable[[DataFrame], DataFrame], results_path: str, checkpoint: str,
                 fmt: str = "json", available_now: bool = True, max_files_per_trigger: int | None = None):
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query_id:
            raise RuntimeError("no streaming query id: the batch can't be kept apart from other intakes")
        out = process(batch).withColumns({"intake_id": F.lit(query_id), "run_id": F.lit(int(batch_id))})
        write_results(out, results_path)

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
