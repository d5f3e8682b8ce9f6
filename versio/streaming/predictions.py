"""Incremental inference with Structured Streaming (S7 flush-per-batch and resume).

The reference flushes predictions after every model batch so a crashed run
keeps its progress. Here new prompt files are picked up by a file stream,
run through the model (X1 + F11 + F12, stateless ``mapInPandas``) and written
by the exactly-once parquet file sink; the checkpoint records which input
files are done, so a restarted run only sends new prompts to the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import infer
from ..session import shared_dir


def prompt_stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet prompt files under ``path`` as a stream."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def stream_predictions(prompts: DataFrame, engine_factory, keys: list[str], out_path: str,
                       prompt_col: str = "model_input", checkpoint_location: str | None = None,
                       batch_size: int = 10, stop: str | None = None,
                       partition_cols: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what exists, then stops."""
    spark = prompts.sparkSession
    if checkpoint_location is None:
        checkpoint_location = shared_dir(spark).rstrip("/") + "/stream-predictions"
    preds = infer.predictions(prompts, prompt_col, engine_factory, keys, batch_size, stop)
    w = (preds.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint_location).outputMode("append"))
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
