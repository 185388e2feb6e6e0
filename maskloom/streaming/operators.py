"""The stateless operators on streams, and running counts of detections."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskloom.operators.detect import DEFAULT_NAMES, detections
from maskloom.sources.scratch import new_folder


def detection_rate(
    lines: DataFrame,
    names: Iterable[str] = DEFAULT_NAMES,
    ts: str = "ts",
    window: str = "1 hour",
    delay: str = "10 minutes",
    col: str = "line",
) -> DataFrame:
    """Detections per kind and event-time window; rows later than ``delay`` are dropped.

    On a stream in append mode a window comes out once the watermark has passed its
    end; the last windows of a drained input wait for later events (``drain_rates``).
    """
    timed = lines.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, delay) if timed.isStreaming else timed
    found = detections(timed, names, col, keep=(ts,))
    counts = found.groupBy(F.window(ts, window).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "kind", "n")


@dataclass(frozen=True)
class Drained:
    """``rates`` with ``closed``, whether the watermark has passed the window's end, and how many groups came too late for theirs."""

    rates: DataFrame
    n_dropped: int


def _run(stream: DataFrame, folder: str) -> StreamingQuery:
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def drain(stream: DataFrame) -> DataFrame:
    """Run an append-mode stream over all available input into a parquet table and read it back."""
    folder = new_folder(stream.sparkSession, "stream")
    _run(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def drain_rates(rates: DataFrame) -> Drained:
    """Run ``detection_rate`` of a stream over all available input: closed windows as they came out, open ones from its state.

    The stream's own checkpoint holds the counts of windows that wait for later
    events. Together both are what the batch call gives, but for rows that came
    after their window was closed; ``late_rates`` tells those.
    """
    spark = rates.sparkSession
    folder = new_folder(spark, "stream")
    query = _run(rates, folder)
    closed = spark.read.schema(rates.schema).parquet(f"{folder}/table").withColumn("closed", F.lit(True))
    dropped = sum(state.numRowsDroppedByWatermark for told in query.recentProgress for state in told.stateOperators)
    if not any(told.stateOperators for told in query.recentProgress):
        return Drained(closed, dropped)  # no batch has run: there is no state
    state = spark.read.format("statestore").load(f"{folder}/progress")
    window = F.col("key.window")
    columns = [window["start"].alias("window_start"), window["end"].alias("window_end"), F.col("key.kind").alias("kind"), F.col("value.count").alias("n")]
    waiting = state.select(*columns, F.lit(False).alias("closed"))
    return Drained(closed.unionByName(waiting), dropped)


def late_rates(whole: DataFrame, drained: DataFrame) -> DataFrame:
    """(window_start, window_end, kind, n_late): what the batch rates count and the drained ones miss."""
    key = ["window_start", "window_end", "kind"]
    both = whole.select(*key, "n").unionByName(drained.select(*key, (-F.col("n")).alias("n")))
    return both.groupBy(*key).agg(F.sum("n").alias("n_late")).where("n_late <> 0")


def drain_complete(stream: DataFrame) -> DataFrame:
    """Run a complete-mode aggregation over all available input; the last full result is the table.

    Every batch is a table of its own, so a batch that is run again or a reader in
    between finds no half-written result.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    # Without any input no batch is ever published: the result is then empty.
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/empty")
    latest = ["empty"]

    def publish(batch: DataFrame, number: int) -> None:
        name = f"batch-{number}"
        batch.write.mode("overwrite").parquet(f"{folder}/{name}")
        latest[0] = name

    query = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{latest[0]}")
