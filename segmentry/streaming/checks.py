"""Row-local checks and redaction over a stream of segments: the same plans, as they keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.checks import Config, check_segments
from ..operators.redact import Layers, redact
from ..schema import segments


def stream_of(spark: SparkSession, path: str, schema: str = "file string, id long, source_text string, target_text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def check_stream(rows: DataFrame, cfg: Config | None = None) -> DataFrame:
    return check_segments(segments(rows), cfg)


def redact_stream(rows: DataFrame, layers: Layers | None = None) -> DataFrame:
    return redact(rows, layers, ("source_text", "target_text"))


def run_available(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Write what there is now and stop."""
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
