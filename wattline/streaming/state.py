"""Per-key state across micro-batches: readings kept in slots, and rounds that timers close.

State lives in a RocksDB store below the checkpoint, so a query that was stopped, or lost its executors, goes on where its last
finished batch ended. What is kept per key is bounded: a fixed number of readings, or a count per distinct value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wattline.operators.features import FLAT
from wattline.operators.risk import accepted

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000


def with_state(stream: DataFrame, by: list[str | Column], processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    """The stream through a processor with one state per key, in append mode."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*by).transformWithStateInPandas(processor, schema, "Append", time_mode)


class TrailingSpikes(StatefulProcessor):
    """Flags readings against the mean and spread of the last ``n``, of which ``n - 1`` are kept in a list."""

    def __init__(self, n: int, k: float):
        self.n, self.k = n, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "demand_mw double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("period", kind="stable")
        kept = [np.nan if r[0] is None else r[0] for r in self.tail.get()] if self.tail.exists() else []
        values = np.concatenate([np.full(self.n - 1 - len(kept), np.nan), kept, new["demand_mw"].to_numpy(float)])
        frames = np.lib.stride_tricks.sliding_window_view(values, self.n)
        known = ~np.isnan(frames)
        count = known.sum(axis=1)
        mean = np.where(known, frames, 0).sum(axis=1) / np.maximum(count, 1)
        squares = (np.where(known, frames - mean[:, None], 0) ** 2).sum(axis=1)
        spread = np.where(count > 1, np.sqrt(squares / np.maximum(count - 1, 1)), 0.0)
        off = np.abs(values[self.n - 1 :] - mean)
        seen = min(self.n - 1, len(kept) + len(new))
        self.tail.put([(None if np.isnan(v) else float(v),) for v in values[len(values) - seen :]])
        yield pd.DataFrame({
            "period": new["period"].to_numpy(), "ba_code": key[0], "demand_mw": new["demand_mw"].to_numpy(),
            "is_spike": (off > self.k * spread) & (spread > FLAT), "spike_magnitude": np.where(spread > FLAT, off / np.where(spread > FLAT, spread, 1), np.nan),
        })


def spikes(hourly: DataFrame, n: int = 24, k: float = 2.0) -> DataFrame:
    """``is_spike`` and ``spike_magnitude`` of closed hourly readings, by the last ``n`` readings of the area across micro-batches.

    ``hourly`` (period, ba_code, demand_mw) emits every hour once and in order of batches, as a streaming aggregate does in append
    mode. A missing value takes a slot, as in a row frame.
    """
    schema = "period timestamp, ba_code string, demand_mw double, is_spike boolean, spike_magnitude double"
    return with_state(hourly.select("period", "ba_code", "demand_mw"), ["ba_code"], TrailingSpikes(n, k), schema)


class Rounds(StatefulProcessor):
    """Counts submissions by value; a timer at the end of the round's hour gives the medians and drops the counts.

    The counts of a round are read and written as one list, in one call each.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = {c: handle.getListState(c, "value bigint, n bigint") for c in ("predicted_mw", "prob_bp")}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        for name, state in self.counts.items():
            counts = Counter(new[name].dropna().astype("int64").tolist())
            if counts and state.exists():
                counts.update(dict(state.get()))
            if counts:
                state.put(list(counts.items()))
        # a millisecond early, so that a watermark at the very end of the hour closes it
        self.handle.registerTimer(int(pd.Timestamp(key[1]).timestamp() * 1000) + HOUR_MS - 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = {"ba_code": [key[0]], "target": [key[1]]}
        totals = []
        for name, state in self.counts.items():
            held = sorted(tuple(row) for row in state.get()) if state.exists() else []
            values, upto = np.array([v for v, _ in held], np.int64), np.cumsum([n for _, n in held])
            total = int(upto[-1]) if held else 0
            lo, hi = (int(values[np.searchsorted(upto, at, "right")]) for at in ((total - 1) // 2, total // 2)) if total else (None, None)
            # as SQL's DIV, an even count's mean is cut towards zero
            out[{"predicted_mw": "median_mw", "prob_bp": "median_prob_bp"}[name]] = [None if lo is None else lo if total % 2 else int((lo + hi) / 2)]
            totals.append(total)
            state.clear()
        yield pd.DataFrame({**out, "n_submissions": [max(totals)]})


def rounds(submissions: DataFrame, late: str = "1 hour") -> DataFrame:
    """Prediction rounds (ba_code, target) with medians, each given once when the watermark passes the end of its hour.

    Every submission (ba_code, target, predicted_mw, prob_bp, submitted_at) made before that end counts, also several of one
    node; probabilities above 10000 are refused. What comes after a round has closed changes nothing. State per round grows with
    its distinct values, not with its submissions.
    """
    due = accepted(submissions).where(F.col("submitted_at") < F.col("target") + F.expr("INTERVAL 1 HOUR"))
    timed = due.select("ba_code", "target", F.col("predicted_mw").cast("bigint").alias("predicted_mw"), F.col("prob_bp").cast("bigint").alias("prob_bp")).withWatermark("target", late)
    schema = "ba_code string, target timestamp, median_mw bigint, median_prob_bp bigint, n_submissions bigint"
    return with_state(timed, ["ba_code", "target"], Rounds(), schema, "EventTime")


class Passing(StatefulProcessor):
    """Hands on what it gets; the operator around it has left out rows behind the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for r in rows:
            yield r


def in_time(stream: DataFrame, delay: str, time: str = "period", keys: int = 64) -> DataFrame:
    """Rows younger than the watermark when they arrive; rows that repeat all stay, and nothing is kept in state.

    Rows are dealt over ``keys`` keys by their values, so a batch that is run again gives the same rows.
    """
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in stream.columns]), F.lit(keys)).cast("int")
    timed = stream.withColumn("_spread", spread).withWatermark(time, delay)
    return with_state(timed, ["_spread"], Passing(), stream.schema, "EventTime")
