"""Streaming jobs.

Each job is a transformation of a streaming DataFrame; ``run_available`` drains the source into a table and
can be started again from its checkpoint. State is kept per time window, so it stays bounded by the
watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattline.functions.measures import ratio
from wattline.sinks import write_merge
from wattline.streaming import state


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there now into a Parquet table, then stop.

    Started again with the same checkpoint it goes on after the last finished batch.
    """
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch to ``handle``, then stop."""
    query = (
        df.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


# --- windowed aggregates ---------------------------------------------------------------------------


def stream_daily(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """Daily demand summary; rows up to ``late`` behind still count, a day is final after that."""
    return (
        stream.withWatermark("period", late)
        .groupBy(F.window("period", "1 day"), "ba_code")
        .agg(
            F.avg("demand_mw").alias("avg_demand"),
            F.max("demand_mw").alias("peak_demand"),
            F.min("demand_mw").alias("min_demand"),
            F.stddev_samp("demand_mw").alias("stddev_demand"),
        )
        .select(F.col("window.start").alias("day"), "ba_code", "avg_demand", "peak_demand", "min_demand", "stddev_demand")
    )


def stream_risk_hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hourly news index per area."""
    return (
        stream.withWatermark("event_time", late)
        .select("event_time", F.explode(F.array_distinct("ba_codes")).alias("ba_code"), "sentiment_score", "risk_magnitude", "event_type")
        .groupBy(F.window("event_time", "1 hour"), "ba_code")
        .agg(
            F.avg("sentiment_score").alias("avg_sentiment"),
            F.min("sentiment_score").alias("min_sentiment"),
            F.max("risk_magnitude").alias("max_risk"),
            F.count_if(F.col("event_type") == "SUPPLY_DISRUPTION").alias("disruption_count"),
            F.count_if(F.col("event_type") == "POLICY").alias("policy_count"),
            F.count(F.lit(1)).alias("total_events"),
        )
        .select(F.col("window.start").alias("hour"), "ba_code", "avg_sentiment", "min_sentiment", "max_risk", "disruption_count", "policy_count", "total_events")
    )


def stream_news_24h(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Trailing 24 h news features every hour, over [h - 24 h, h).

    Events are added up per hour first, so the sliding window multiplies hourly totals and not events.
    """
    hourly = (
        stream.withWatermark("event_time", late)
        .select("event_time", F.explode(F.array_distinct("ba_codes")).alias("ba_code"), "sentiment_score", "risk_magnitude", (F.col("event_type") == "SUPPLY_DISRUPTION").alias("_d"))
        .groupBy(F.window("event_time", "1 hour"), "ba_code")
        .agg(F.sum("sentiment_score").alias("_s"), F.count("sentiment_score").alias("_c"), F.max("risk_magnitude").alias("_r"), F.count(F.lit(1)).alias("_n"), F.bool_or("_d").alias("_d"))
    )
    return (
        hourly.groupBy(F.window(F.window_time("window"), "24 hours", "1 hour"), "ba_code")
        .agg(
            ratio(F.sum("_s"), F.sum("_c").cast("double")).alias("news_sentiment_24h"),
            F.max("_r").alias("news_max_risk_24h"),
            F.sum("_n").alias("news_event_count_24h"),
            F.bool_or("_d").alias("supply_disruption_24h"),
        )
        .select(F.col("window.end").alias("period"), "ba_code", "news_sentiment_24h", "news_max_risk_24h", "news_event_count_24h", "supply_disruption_24h")
    )


def stream_episodes(spikes: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Alert episodes: runs of spikes of an area less than ``gap`` apart."""
    return (
        spikes.withWatermark("period", late)
        .groupBy(F.session_window("period", gap), "ba_code")
        .agg(F.count(F.lit(1)).alias("n_spikes"), F.max("demand_mw").alias("peak_mw"))
        .select(F.col("session_window.start").alias("first_time"), F.col("session_window.end").alias("closed_at"), "ba_code", "n_spikes", "peak_mw")
    )


# --- idempotent ingestion ------------------------------------------------------------------------


def stream_dedupe(stream: DataFrame, keys: list[str], time: str = "period", late: str = "3 days") -> DataFrame:
    """First arrival of every key within the watermark; late rows are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drop_late(stream: DataFrame, delay: str, time: str = "period") -> DataFrame:
    """Rows that are younger than the watermark when they arrive; rows that repeat all stay."""
    return state.in_time(stream, delay, time)


def stream_merge(stream: DataFrame, path: str, keys: list[str], checkpoint: str, time: str = "period") -> StreamingQuery:
    """Insert-ignore every micro-batch into a table; a batch that is run again adds nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        write_merge(batch.sparkSession, batch, path, keys, time)

    return run_batches(stream, merge, checkpoint)


# --- spikes with history ---------------------------------------------------------------------------


def stream_spikes(hourly: DataFrame, n: int = 24, k: float = 2.0) -> DataFrame:
    """Flag spikes of closed hourly readings with the ``n - 1`` readings before, across micro-batches."""
    return state.spikes(hourly, n, k)


def hourly_readings(stream: DataFrame, late: str = "1 hour", value: str = "demand_mw") -> DataFrame:
    """Sum of readings per closed hour and area."""
    return (
        stream.withWatermark("period", late)
        .groupBy(F.window("period", "1 hour"), "ba_code")
        .agg(F.sum(value).alias(value))
        .select(F.col("window.start").alias("period"), "ba_code", value)
    )


# --- prediction rounds --------------------------------------------------------------------------


def stream_rounds(submissions: DataFrame, late: str = "1 hour") -> DataFrame:
    """Prediction rounds with their medians, given once their hour lies behind the watermark."""
    return state.rounds(submissions, late)
