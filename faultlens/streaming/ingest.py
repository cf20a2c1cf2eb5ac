"""Resumable ingestion of batch files as a stream that ends when no file is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultlens.operators.rows import canonical
from faultlens.sources.campaign import RAW, RAW_2, schema


def ingest(spark: SparkSession, folder: str, out: str, progress: str, version: int = 1) -> DataFrame:
    """Every new campaign CSV of folder as canonical rows in out, once each; a rerun goes on where the last stopped.

    progress holds the stream's checkpoint. Record ids need all batches and are left to consolidate().
    """
    raw = spark.readStream.schema(schema(RAW if version == 1 else RAW_2)).option("header", True).option("mode", "FAILFAST").csv(folder)
    query = canonical(raw).writeStream.format("parquet").option("checkpointLocation", progress).option("path", out).partitionBy("batch_id").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
