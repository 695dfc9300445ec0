"""Streams of tracking rows in any order: what depends on the rows before waits for its turn.

Rows are kept in state under their event time until the watermark has passed it; then timers hand them
on in order, so a stream gives the rows of the batch however its rows are dealt to micro-batches, and
goes on from its checkpoint. Rows that come later than the watermark are left out. State lies in RocksDB
(see rocks). Interpolation looks ahead and so is left to batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from trackloom.operators.possession import TIMELINE, hold
from trackloom.operators.repair import gains
from trackloom.schema import TRACK, TRACKING

Step = Callable[[dict, list[dict]], Iterator[tuple]]


def rocks(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Hands the rows of a key to step(state, rows), those of one event time together, in order of time."""

    def __init__(self, step: Step, start: dict, out: list[str]):
        self.step, self.start, self.out = step, start, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows string")
        self.state = handle.getValueState("state", "done long, kept string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        done = self.state.get()[0] if self.state.exists() else -1
        fresh: dict[int, list[dict]] = {}
        for row in rows:
            if row["_at"] > done:
                fresh.setdefault(row["_at"], []).append({k: v for k, v in row.asDict().items() if k not in ("_at", "_time")})
        for at, own in fresh.items():
            if self.waiting.containsKey((at,)):
                own = json.loads(self.waiting.getValue((at,))[0]) + own
            else:
                self.handle.registerTimer(at)
            self.waiting.updateValue((at,), (json.dumps(own),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        kept = json.loads(self.state.get()[1]) if self.state.exists() else dict(self.start)
        rows = json.loads(self.waiting.getValue((at,))[0])
        self.waiting.removeKey((at,))
        for values in self.step(kept, rows):
            yield Row(**dict(zip(self.out, values, strict=True)))
        self.state.update((at, json.dumps(kept)))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], time: Column, late: str, step: Step, start: dict, schema: T.StructType) -> DataFrame:
    """rows under a watermark, handed on in order; time: a timestamp column of event time."""
    timed = rows.withColumn("_time", time).withWatermark("_time", late).withColumn("_at", F.unix_millis("_time"))
    return timed.groupBy(*keys).transformWithState(InOrder(step, start, schema.names), schema, "Append", "EventTime")


def match_time(seconds: Column | None = None) -> Column:
    """An event time from seconds of a match; all matches of a stream begin at one time."""
    return F.timestamp_millis(F.round((F.col("timestamp") if seconds is None else seconds) * 1000).cast("long"))


def filter_stream(tracking: DataFrame, time: Column | None = None, late: str = "5 seconds", process_noise: float = 0.001, measurement_noise: float = 0.01) -> DataFrame:
    """repair.causal_filter on a stream of tracking: the same rows once the watermark has passed them.

    A track's state is its last frame and position, its velocity, and how many updates it has had, which
    tells the gain from the table that the batch uses too.
    """
    table, last_gain = gains(process_noise, measurement_noise)

    def step(kept: dict, rows: list[dict]) -> Iterator[tuple]:
        for row in sorted(rows, key=lambda r: r["frame"]):
            here = [row["x"], row["y"]]
            if not row["visible"] or None in here:
                kept["frame"] = None
            elif kept["frame"] is None or row["frame"] != kept["frame"] + 1:
                kept |= {"frame": row["frame"], "at": here, "speed": [0.0, 0.0]}
            else:
                gain = table[kept["updates"]] if kept["updates"] < len(table) else last_gain
                error = [h - a - v for h, a, v in zip(here, kept["at"], kept["speed"], strict=True)]
                here = [a + v + gain * e for a, v, e in zip(kept["at"], kept["speed"], error, strict=True)]
                kept |= {"frame": row["frame"], "at": here, "speed": [v + gain * e / 2 for v, e in zip(kept["speed"], error, strict=True)], "updates": kept["updates"] + 1}
            yield tuple((row | {"x": here[0], "y": here[1]})[c] for c in TRACKING.names)

    return in_order(tracking.select(*TRACKING.names), TRACK, match_time() if time is None else time, late, step, {"frame": None, "at": None, "speed": None, "updates": 0}, TRACKING)


def possession_stream(scores: DataFrame, time: Column | None = None, late: str = "5 seconds", switch_margin: float = 0.15, persistence_window: int = 5, min_score_threshold: float = 0.10) -> DataFrame:
    """possession.predict_possession on a stream of scored rows: match_id, frame, timestamp, team, player_id, raw_score.

    A frame without scored players is a row with a null player. A match's state is the holder and since how many frames.
    """

    def step(kept: dict, rows: list[dict]) -> Iterator[tuple]:
        frames: dict[int, list[dict]] = {}
        for row in rows:
            frames.setdefault(row["frame"], []).append(row)
        for frame, own in sorted(frames.items()):
            scored = sorted((-r["raw_score"], r["team"], r["player_id"]) for r in own if r["raw_score"] is not None)
            holder = tuple(kept["holder"]) if kept["holder"] else None
            holder, kept["since"], score, confidence = hold(holder, kept["since"], [r[1] for r in scored], [r[2] for r in scored], [-r[0] for r in scored], switch_margin, persistence_window, min_score_threshold)
            kept["holder"] = holder
            yield own[0]["match_id"], frame, own[0]["timestamp"], holder and holder[1], holder and holder[0], score, confidence

    schema = T.StructType.fromDDL(TIMELINE)
    return in_order(scores.select("match_id", "frame", "timestamp", "team", "player_id", "raw_score"), ["match_id"], match_time() if time is None else time, late, step, {"holder": None, "since": 0}, schema)


def visible_counts(tracking: DataFrame, time: str, window: str = "1 second", late: str = "5 seconds") -> DataFrame:
    """Visible rows and all rows per match, team and window of event time; rows later than late are left out."""
    return tracking.withWatermark(time, late).groupBy(F.window(time, window), "match_id", "team").agg(F.count_if("visible").alias("visible"), F.count("*").alias("rows"))
