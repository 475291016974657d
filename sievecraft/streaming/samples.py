"""Structured Streaming over sample files: the row-wise part of curation, as batches arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.filters import validate_samples


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def validated(stream: DataFrame, min_length: int = 10, max_length: int = 10_000, allowed_labels: Sequence[str] | None = None) -> DataFrame:
    return validate_samples(stream, min_length, max_length, allowed_labels)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Append what is there now to Parquet at path, exactly once over restarts; returns the number of batches."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return (query.lastProgress.batchId + 1) if query.lastProgress else 0


def exact_dedup_stream(stream: DataFrame, seq_time: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of each text within the watermark: state is dropped after delay."""
    from ..functions.text import normalize

    return stream.withColumn("_digest", F.sha2(normalize(F.col("text")), 256)).withWatermark(seq_time, delay).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")
