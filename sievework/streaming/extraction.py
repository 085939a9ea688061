"""Extraction over a stream of texts: the batch plan, unchanged, in append mode and without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sievework.api import Extractor
from sievework.schema import Schema


def texts(spark: SparkSession, path: str, schema: str = "doc_id long, text string", **options: str) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def extract_to(stream: DataFrame, extractor: Extractor, schema: Schema, path: str, checkpoint: str, **more) -> StreamingQuery:
    """Writes results of all texts that there are now, once each, and ends."""
    out = extractor.extract(stream, schema, **more)
    return out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
