"""Streams: the scan for personal data over arriving texts, and ids once within a watermark.

An extension of this library's own. The scan has no state; duplicate ids are dropped within the watermark, so
state is bounded by the lateness that is allowed and not by the stream's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.functions.packs import Pack
from talkgauge.operators.profile import span_rows
from talkgauge.sources.shared import shared_folder

def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files that are or come to be at ``path``."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def caught_up(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """What the stream yields until it has read all that is there, as a table."""
    top = shared_folder(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def scanned(stream: DataFrame, pack: Pack, column: str = "text") -> DataFrame:
    """One row per personal datum in a stream's texts: where and what kind, never the value."""
    return span_rows(stream, F.col(column), pack).drop(column)


def rescan_once(spark: SparkSession, path: str, pack: Pack) -> DataFrame:
    found = caught_up(scanned(arriving(spark, path).select("doc_id", "text"), pack), spark)
    return found.filter("type = 'email'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def first_within(stream: DataFrame, id_col: str, time_col: str, late: str = "1 hour") -> DataFrame:
    """Rows whose id has not been seen within the watermark."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def hourly_once(spark: SparkSession, path: str) -> DataFrame:
    events = first_within(arriving(spark, path).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), "event_id", "ts")
    return caught_up(events, spark).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
