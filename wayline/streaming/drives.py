"""Live drives: the capture gate, replayed events, bounded queues and streamed answers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayline.functions.decide import prefix_decision
from wayline.operators.dedupe import _metres

#: Fixed values of the gate, in metres, metres a second and seconds.
SPACING_M, MOVING_MPS, COARSE_M = 6.0, 1.0, 30.0
LEAST_S, MOST_S, PARKED_S, FALLBACK_S, STALE_S = 0.75, 2.0, 8.0, 1.0, 10.0
GATED = "drive_id string, ts double, lat double, lng double, capture boolean"


def cadence(speed: float | None, accuracy: float | None) -> float:
    """Seconds between captures at a speed."""
    coarse = accuracy is None or math.isnan(accuracy) or accuracy > COARSE_M
    if speed is not None and not math.isnan(speed) and speed <= MOVING_MPS and not coarse:
        return PARKED_S
    if speed is not None and not math.isnan(speed) and speed > MOVING_MPS:
        return max(LEAST_S, min(MOST_S, math.floor(SPACING_M / speed * 1000) / 1000))
    return FALLBACK_S


def gate(rows: list[dict], last: tuple[float, float, float] | None) -> tuple[list[bool], tuple[float, float, float] | None]:
    """Which fixes of a drive, in order, trigger a capture, given the last one captured as (ts, lat, lng)."""
    fired = []
    for r in rows:
        fresh = r["now"] - r["ts"] <= STALE_S
        fire = fresh and (
            last is None
            or _metres({"lat": last[1], "lng": last[2]}, r) >= SPACING_M
            or r["now"] - last[0] >= cadence(r["speed_mps"], r["accuracy"])
        )
        fired.append(fire)
        if fire:
            last = (r["now"], r["lat"], r["lng"])
    return fired, last


def _fixes(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["ts", "lat", "lng"])
    return frame if "now" in frame else frame.assign(now=frame["ts"])


def capture_gate(fixes: DataFrame) -> DataFrame:
    """The gate over stored fixes (drive_id, ts in seconds, lat, lng, accuracy, speed_mps, and optionally now)."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _fixes(frame)
        fired, _ = gate(frame.to_dict("records"), None)
        return frame[["drive_id", "ts", "lat", "lng"]].assign(capture=fired)

    return fixes.groupBy("drive_id").applyInPandas(one, GATED)


def stream_capture_gate(fixes: DataFrame) -> DataFrame:
    """The gate over a stream of fixes; the state of a drive is the last fix it captured."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for frame in frames:
            frame = _fixes(frame)
            fired, last = gate(frame.to_dict("records"), last)
            yield frame[["drive_id", "ts", "lat", "lng"]].assign(capture=fired)
        if last is not None:
            state.update(last)

    return fixes.groupBy("drive_id").applyInPandasWithState(step, GATED, "ts double, lat double, lng double", "append", GroupStateTimeout.NoTimeout)


def without_replays(events: DataFrame, time: str = "captured_at", key: str = "source_event_key", horizon: str = "30 days") -> DataFrame:
    """A stream with each source key once within the horizon."""
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def keep_newest(queue: DataFrame, capacity: int = 6) -> DataFrame:
    """What a bounded queue that drops its oldest holds, for each drive, by arrival."""
    turn = F.row_number().over(Window.partitionBy("drive_id").orderBy(F.desc("seq")))
    return queue.withColumn("_turn", turn).withColumn("kept", F.col("_turn") <= capacity).drop("_turn")


def first_verdicts(deltas: DataFrame, key: str) -> DataFrame:
    """The verdict of each streamed answer as soon as what has come settles it: (key, decision, decided_at).

    `deltas` has the key, seq and delta, the pieces of a JSON text in order. An answer is a few kilobytes, so its pieces
    so far fit a row; answers that never settle are left out.
    """
    so_far = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = deltas.withColumn("decision", prefix_decision(F.array_join(F.collect_list("delta").over(so_far), "")))
    return told.where("decision IS NOT NULL").groupBy(key).agg(F.min_by("decision", "seq").alias("decision"), F.min("seq").alias("decided_at"))
