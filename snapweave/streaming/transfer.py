"""Totals, rates and sessions of a transfer log as streams. A Spark capability, with the batch summaries as its model."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import shared_dir
from .sink import CommittedBatches, run_available


def stream_side_totals(log: DataFrame) -> DataFrame:
    """(label, bytes, samples) of a streaming log (label, bytes); for complete or update mode."""
    return log.groupBy("label").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("samples"))


def windowed_totals(log: DataFrame, span: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(label, begin, bytes) of tumbling event-time windows over a streaming log (label, at TIMESTAMP, bytes); later rows than `late` are dropped."""
    grouped = log.withWatermark("at", late).groupBy("label", F.window("at", span).alias("w"))
    return grouped.agg(F.sum("bytes").alias("bytes")).select("label", F.col("w.start").alias("begin"), "bytes")


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process what is there now; the result of the last batch is a table in the shared folder."""
    spark = SparkSession.active()
    at = f"{shared_dir(spark)}/stream-{name}"

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/result")

    writer = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/result")


def sliding_totals(log: DataFrame, span: str = "2 seconds", step: str = "200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(label, begin, bytes, samples) of event-time windows of `span` that begin every `step`, over a streaming log (label, at TIMESTAMP, bytes).

    For append mode: a window comes out once the watermark, `late` behind the newest sample, has passed its end; a later row counts only in its windows that are still open.
    """
    grouped = log.withWatermark("at", late).groupBy("label", F.window("at", span, step).alias("w"))
    return grouped.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("samples")).select("label", F.col("w.start").alias("begin"), "bytes", "samples")


#: A pause of 750 ms ends a session; windows of one microsecond less keep samples that far apart in two sessions (fixed value).
PAUSE_US = 750_000


def active_sessions(log: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(label, begin, last, bytes, samples) of the spans in which a side is never idle for 750 ms, over a streaming log (label, at TIMESTAMP, bytes).

    Sessions merge across micro-batches. For append mode: one comes out once the watermark has passed its pause.
    """
    grouped = log.withWatermark("at", late).groupBy("label", F.session_window("at", f"{PAUSE_US - 1} microseconds").alias("w"))
    sums = grouped.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("samples"))
    last = F.timestamp_micros(F.unix_micros("w.end") - (PAUSE_US - 1))
    return sums.select("label", F.col("w.start").alias("begin"), last.alias("last"), "bytes", "samples")


class Landing:
    """A folder in which rows arrive in slices, each whole before a stream reads it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._slices = spark, root, 0

    def land(self, rows: DataFrame) -> None:
        self._slices += 1
        rows.write.parquet(f"{self.root}/slice-{self._slices:06d}")

    def stream(self, schema: StructType) -> DataFrame:
        return self.spark.readStream.schema(schema).parquet(f"{self.root}/slice-*")


def replay(log: DataFrame, at: str, slices: int, process: Callable[[DataFrame], DataFrame], name: str, mode: str, store: str | None = None) -> CommittedBatches:
    """Lands a log in slices of time; after each, the stream starts anew from its checkpoint, takes what is there and stops."""
    spark = log.sparkSession
    root = f"{shared_dir(spark)}/replay-{name}-{uuid.uuid4().hex}"
    landing, sink = Landing(spark, f"{root}/in"), CommittedBatches(spark, f"{root}/out")
    bounds = log.approxQuantile(at, [k / slices for k in range(1, slices)], 0.001)
    edges = [None, *dict.fromkeys(int(x) for x in bounds), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        inside = F.lit(True) if low is None else F.col(at) > low
        landing.land(log.where(inside if high is None else inside & (F.col(at) <= high)))
        run_available(process(landing.stream(log.schema)), sink, mode, store)
    return sink
