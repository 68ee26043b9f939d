"""A stream of events as updates of a graph: each micro-batch becomes quads that are added to
Parquet under the number of its batch, so a batch that is run again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import SCHEMA, QuadStore


def ingest(stream: DataFrame, to_quads: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, watermark: tuple[str, str] | None = None):
    """Starts the stream; ``to_quads`` maps rows to s, p, o, g. Returns the running query."""
    if watermark:
        stream = stream.withWatermark(*watermark)

    def write(batch: DataFrame, k: int) -> None:
        to_quads(batch).select("s", "p", "o", "g").write.mode("overwrite").parquet(f"{folder}/batch={k}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, folder: str) -> QuadStore:
    """The graph as of now: all batches written so far, each quad once."""
    quads = spark.read.schema(SCHEMA + ", batch long").parquet(folder).select("s", "p", "o", "g")
    return QuadStore(spark, quads.distinct())


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Count of events by key and tumbling window; events later than ``late`` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
