"""Streaming intake: journals to classed segments to gated candidates, and the silence that starts a pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.operators import gate, intake
from attesta.sources import journals


def lines(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """A stream of journal lines: key, pos, next, line, skipped."""
    journals.register(spark)
    return spark.readStream.format("journals").options(path=pattern, **options).load()


def evidence(stream: DataFrame) -> DataFrame:
    """Judged evidence lines of a stream (or of a batch): key, pos, reason, cls, text, at."""
    rows = stream.withColumn("line_no", F.col("pos"))
    return intake.validated(rows).select("key", "pos", F.coalesce("skipped", "reason").alias("reason"), "cls", "text", "at")


def run(stream: DataFrame, checkpoint: str, spot: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, int], None], store: DataFrame | None = None) -> StreamingQuery:
    """Gate every batch of classed segments (key, pos, cls, text): spot proposes candidates from them (a model, or a rule), keep takes what the gate decides.

    One run is one sip of the stream's bound ('chars'); run it again for the next. keep gets the batch's number and must change nothing when it comes again (StoreTable.upsert with batch does).
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            segments = batch.where("reason is null").select(F.concat(F.lit(f"{number}:"), "key").alias("batch"), "pos", "cls", "text")
            keep(gate.gate(spot(segments), segments, store), number)
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()


def quiet(events: DataFrame, minutes: int = 10, late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """key, start, end, n of each run of a stream's events that silence of minutes has closed; rows later than late are dropped by the watermark."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    runs = stamped.groupBy(key, F.session_window(ts, f"{minutes} minutes").alias("s")).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
