"""Incremental fact build over arriving raw telemetry files.

The reference has no streaming; its cleaning job re-reads whole raw files.
When new raw files keep arriving (one per reporting period), the same
``fact_build`` (parse the text timestamp, drop redundant columns) can run
as a Structured Streaming query over the folder: each file is processed
once, results are appended to parquet, and progress is kept in a
checkpoint under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from zonestats.functions.columns import RAW_TIMESTAMP_FORMAT
from zonestats.operators.dims import fact_build


def ingest_facts(spark: SparkSession, raw_dir: str, out_dir: str, schema: StructType | str,
                 ts_col: str, drop: Sequence[str] = (), fmt: str = RAW_TIMESTAMP_FORMAT,
                 checkpoint: str | None = None, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes every file
    present now (in bounded micro-batches) and stops."""
    reader = spark.readStream.schema(schema).option("header", True).option("mode", "FAILFAST")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.csv(raw_dir)
    facts = fact_build(raw, ts_col, drop=drop, fmt=fmt)
    # beside the output, so that the next application goes on where this one ended
    ckpt = checkpoint or out_dir.rstrip("/") + "/_ingest_checkpoint"
    writer = (facts.writeStream.format("parquet").outputMode("append")
              .option("path", out_dir).option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
