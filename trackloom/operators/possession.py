"""Possession from geometry and motion: scores, the hysteresis timeline, candidate events, summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.graph import PLAYER, Players, by_frame, first_of, least
from trackloom.schema import FRAME, tracking_only

# Weights of the features.
WEIGHTS = {
    "opponent_proximity": 0.25,
    "teammate_proximity": 0.15,
    "local_density": 0.15,
    "centrality": 0.10,
    "movement_continuity": 0.15,
    "forward_progress": 0.10,
    "team_compactness": 0.10,
}
TIMELINE = "match_id string, frame long, timestamp double, possessor_id string, team string, possession_score double, confidence double"
EVENTS = "match_id string, frame long, timestamp double, event_type string, from_player_id string, to_player_id string, from_team string, to_team string"


def frame_index(tracking: DataFrame) -> DataFrame:
    """(match_id, frame, timestamp, fi): fi counts the frames present. One row per frame goes through the window."""
    frames = tracking.groupBy(*FRAME).agg(F.min("timestamp").alias("timestamp"))
    return frames.withColumn("fi", F.row_number().over(Window.partitionBy("match_id").orderBy("frame")))


SCORES = "match_id string, frame long, timestamp double, fi int, team string, player_id string, " + ", ".join(f"{k} double" for k in WEIGHTS) + ", raw_score double"
LISTS = "match_id string, frame long, team array<string>, player_id array<string>, raw_score array<double>"


def _spread(values: np.ndarray, some: np.ndarray, start: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Per run the deviation of some of its values, exactly 0 where these are equal; NaN doesn't count."""
    some = some & ~np.isnan(values)
    low = least(values, some, start)
    off = np.where(some, values - np.repeat(low, runs), 0.0)
    n = np.maximum(np.add.reduceat(some, start, dtype=np.int64), 1)
    off = np.where(some, off - np.repeat(np.add.reduceat(off, start) / n, runs), 0.0)
    return np.sqrt(np.add.reduceat(off * off, start) / n)


def _score(batches: Iterator[pa.RecordBatch], w: dict[str, float], radius: float, centre: tuple[float, float], shape: str) -> Iterator[pa.RecordBatch]:
    """Whole frames' rows with their scores ('rows'), only each frame's best one ('best'), or a row of LISTS a frame, highest score first ('lists')."""
    for batch in batches:
        t = Players(batch)
        start, runs = t.at, t.size
        raw = {k: np.zeros(len(t.frame)) for k in WEIGHTS}
        for places, begin, other in t.beside(np.arange(len(t.frame))):
            n = np.diff(begin, append=len(other))
            one = np.repeat(places, n)
            dist, (mate, foe) = t.apart(one, other), t.sides(one, other)
            raw["opponent_proximity"][places], raw["teammate_proximity"][places] = least(dist, foe, begin), least(dist, mate, begin)
            raw["local_density"][places] = np.add.reduceat((mate | foe) & (dist < radius), begin, dtype=np.int64)
            side = t.team[one] == t.team[other]
            spread = _spread(t.x[other], side, begin, n) + _spread(t.y[other], side, begin, n)
            raw["team_compactness"][places] = np.where(np.add.reduceat(side, begin, dtype=np.int64) > 1, 1.0 / (spread + 1e-6), 0.0)
        for k in ("opponent_proximity", "teammate_proximity"):
            # no neighbour counts as 0.01 beyond the frame's largest distance, or as 1
            d = np.where(np.isinf(raw[k]), np.nan, raw[k])
            far = np.fmax.reduceat(d, start) + 0.01
            raw[k] = 1.0 / (np.where(np.isnan(d), np.repeat(np.where(np.isnan(far), 1.0, far), runs), d) + 1e-6)
        raw["centrality"] = 1.0 / (np.sqrt((t.x - centre[0]) ** 2 + (t.y - centre[1]) ** 2) + 1e-6)
        for k, own in (("movement_continuity", "continuity"), ("forward_progress", "ahead")):
            if own in t.column:
                raw[k] = t.column[own].to_numpy(zero_copy_only=False)
        total = np.zeros(len(t.frame))
        for k in WEIGHTS:
            low, high = np.fmin.reduceat(raw[k], start), np.fmax.reduceat(raw[k], start)
            span = np.repeat(high - low, runs)
            with np.errstate(invalid="ignore", divide="ignore"):
                raw[k] = np.where(span < 1e-12, 0.0, (raw[k] - np.repeat(low, runs)) / span)
            total = total + raw[k] * w[k]
        total = np.floor(total * 1e9 + 0.5) / 1e9
        null = lambda v: pa.array(v, mask=np.isnan(v))
        if shape == "lists":
            order = np.lexsort((-total, t.frame))
            ends = pa.array(np.append(start, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, v) for v in (*[t.column[c].take(pa.array(order)) for c in ("team", "player_id")], null(total[order]))]
            yield pa.RecordBatch.from_arrays([*[t.column[c].take(pa.array(start)) for c in FRAME], *lists], [c.split()[0] for c in LISTS.split(", ")])
            continue
        keep = np.arange(len(t.frame))
        if shape == "best":  # highest first, nulls last, then the order of team and id
            ranked = np.where(np.isnan(total), -np.inf, total)
            keep = first_of(ranked == np.repeat(np.maximum.reduceat(ranked, start), runs), start)
        own = {c: t.column[c].take(pa.array(keep)) for c in (*FRAME, "timestamp", "fi", "team", "player_id") if c in t.column}
        yield pa.RecordBatch.from_arrays([*own.values(), *[null(raw[k][keep]) for k in WEIGHTS], null(total[keep])], [*own, *WEIGHTS, "raw_score"])


def _scores(tracking: DataFrame, weights: dict[str, float] | None = None, density_radius: float = 0.05, dt: float = 0.04, centre: tuple[float, float] = (0.5, 0.5), dynamic: bool = True, shape: str = "rows", index: bool = True) -> DataFrame:
    """Without index and motion nothing asks which frame comes before, so the rows are dealt to their frames once and nothing is joined."""
    w = WEIGHTS | (weights or {})
    tracking = tracking_only(tracking)
    rows = tracking.where("visible AND match_id IS NOT NULL AND frame IS NOT NULL").select(*FRAME, *PLAYER)
    if dynamic or index:
        rows = rows.join(frame_index(tracking).select(*FRAME, "fi"), FRAME)
    if dynamic:
        # motion hangs on a track's rows before: these are dealt and sorted by track once, and go back to their frames
        track = Window.partitionBy("match_id", "team", "player_id").orderBy("frame")
        one, two = F.lag("fi").over(track) == F.col("fi") - 1, F.lag("fi", 2).over(track) == F.col("fi") - 2
        for c in ("x", "y"):
            p1, p2 = F.lag(c).over(track), F.lag(c, 2).over(track)
            rows = rows.withColumn(f"v{c}", F.when(one, (F.col(c) - p1) / dt)).withColumn(f"u{c}", F.when(one & two, (p1 - p2) / dt).when(one, 0.0))
        change = F.sqrt(F.pow(F.col("vx") - F.col("ux"), 2) + F.pow(F.col("vy") - F.col("uy"), 2)) / dt
        ahead = F.when(F.col("team") == "home", F.col("vx")).otherwise(-F.col("vx"))
        motion = [F.coalesce(1.0 / (change + 1e-6), F.lit(0.0)).alias("continuity"), F.coalesce(F.greatest(ahead, F.lit(0.0)), F.lit(0.0)).alias("ahead")]
        rows = rows.select(*FRAME, *["fi"] * index, *PLAYER, *motion)
    schema = LISTS if shape == "lists" else SCORES if index else SCORES.replace("fi int, ", "")
    return by_frame(rows, lambda batches: _score(batches, w, density_radius, centre, shape), schema)


def possession_scores(tracking: DataFrame, **options) -> DataFrame:
    """A row per visible player and frame with the seven features and raw_score (rounded to 9 decimals).

    Options: weights, density_radius, dt, centre, dynamic, index (else without fi). Motion is that to the previous frame present in the
    match; without dynamic the two motion features are 0. Features of a frame are computed where its rows
    lie, so rows are sorted by frame and, for motion, by track, and pairs of them never.
    """
    return _scores(tracking, **options)


def hold(holder: tuple | None, since: int, teams: list, ids: list, scores: list, margin: float, window: int, least: float) -> tuple[tuple | None, int, float, float]:
    """The holder (team, id) after a frame with these scores, highest first, for how many frames, its score and confidence.

    A holder gives way only after window frames, and to one who leads by margin; below least nobody holds.
    """
    top = scores[0] if scores else 0.0
    if not scores or top < least:
        now, value = None, 0.0
    else:
        now, value = (teams[0], ids[0]), top
        if holder not in (None, now):
            mine = next((s for t, i, s in zip(teams, ids, scores, strict=True) if (t, i) == holder), 0.0)
            if since < window or top - mine < margin:
                now, value = holder, mine
    return now, since + 1 if now == holder else 1, value, min(1.0, value / top) if now and top > 0 else 0.0


def predict_possession(tracking: DataFrame, switch_margin: float = 0.15, persistence_window: int = 5, min_score_threshold: float = 0.10, **options) -> DataFrame:
    """The possession timeline: a row per frame present, possessor null without players or below the threshold.

    Who holds the ball depends on who held it before, so each match goes by in order of its frames, a
    row each; what is kept between frames is the holder and how long. Matches run side by side.
    """
    tracking = tracking_only(tracking)
    scored = _scores(tracking, shape="lists", index=False, **options)
    rows = frame_index(tracking).join(scored, FRAME, "left")
    rows = rows.select(*FRAME, "timestamp", "fi", *[F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c) for c, kind in (("team", "string"), ("player_id", "string"), ("raw_score", "double"))])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = holder = None
        since = 0
        for batch in batches:
            ids, teams, scores = (batch.column(c).to_pylist() for c in ("player_id", "team", "raw_score"))
            who, score, confidence = [], [], []
            for m, own_teams, own_ids, own in zip(batch.column("match_id").to_pylist(), teams, ids, scores, strict=True):
                if m != match:
                    match, holder, since = m, None, 0
                holder, since, value, sure = hold(holder, since, own_teams, own_ids, own, switch_margin, persistence_window, min_score_threshold)
                who.append(holder)
                score.append(value)
                confidence.append(sure)
            columns = [pa.array([w and w[1] for w in who], pa.string()), pa.array([w and w[0] for w in who], pa.string()), pa.array(score, pa.float64()), pa.array(confidence, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("match_id"), batch.column("frame"), batch.column("timestamp"), *columns], [c.split()[0] for c in TIMELINE.split(", ")])

    return rows.repartition("match_id").sortWithinPartitions("match_id", "fi").mapInArrow(follow, TIMELINE)


def infer_events(timeline: DataFrame) -> DataFrame:
    """Candidate events at changes of the possessor; a recovery where a team gets back what it lost last."""
    order = Window.partitionBy("match_id").orderBy("frame")
    t = timeline.withColumns({"from_player_id": F.lag("possessor_id").over(order), "from_team": F.lag("team").over(order), "n": F.row_number().over(order)})
    changed = ~(F.col("from_player_id").eqNullSafe(F.col("possessor_id")) & F.col("from_team").eqNullSafe(F.col("team")))
    t = t.where((F.col("n") > 1) & changed)
    turn = ~F.col("from_team").eqNullSafe(F.col("team"))
    lost = F.lag("from_team").over(Window.partitionBy("match_id", "turn").orderBy("frame"))
    t = t.withColumn("turn", turn).withColumn("lost", lost)
    kind = F.when(F.col("from_team").isNull() | F.col("team").isNull(), "possession_change").when(F.col("from_team") == F.col("team"), "pass_candidate").otherwise("turnover_candidate")
    back = F.col("turn") & F.col("from_team").isNotNull() & (F.col("lost") == F.col("team"))
    kinds = F.when(back, F.array(kind, F.lit("recovery_candidate"))).otherwise(F.array(kind))
    return t.select("match_id", "frame", "timestamp", F.explode(kinds).alias("event_type"), "from_player_id", F.col("possessor_id").alias("to_player_id"), "from_team", F.col("team").alias("to_team"))


def possession_summary(timeline: DataFrame) -> DataFrame:
    """Per match: frames, frames with a possessor, switches, share of either team (percent, one decimal), mean confidence."""
    order = Window.partitionBy("match_id").orderBy("frame")
    changed = (F.row_number().over(order) > 1) & ~F.lag("possessor_id").over(order).eqNullSafe(F.col("possessor_id"))
    t = timeline.withColumn("changed", changed)
    share = lambda team: F.round(100.0 * F.count_if(F.col("team") == team) / F.count("*"), 1)
    return t.groupBy("match_id").agg(
        F.count("*").alias("total_frames"),
        F.count("possessor_id").alias("possessed_frames"),
        F.count_if("changed").alias("switches"),
        share("home").alias("home_share"),
        share("away").alias("away_share"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def best_scores(tracking: DataFrame, **options) -> DataFrame:
    """The row of possession_scores with the highest score of each frame, ties by team, then id: found where the frame lies."""
    return _scores(tracking, shape="best", **options)


def memoryless(tracking: DataFrame, **options) -> DataFrame:
    """The possessor of each frame by static scores alone; without fi."""
    return best_scores(tracking, dynamic=False, index=False, **options)


def video_events(possessor: DataFrame) -> DataFrame:
    """PASS between teammates; BALL LOST and RECOVERY, two rows, where the team changes; RECOVERY at the start."""
    order = Window.partitionBy("match_id").orderBy("frame")
    t = possessor.withColumns({"from_id": F.lag("player_id").over(order), "from_team": F.lag("team").over(order)})
    t = t.where(F.col("from_id").isNull() | (F.col("from_id") != F.col("player_id")) | (F.col("from_team") != F.col("team")))
    event = lambda kind, team, a, b: F.struct(F.lit(kind).alias("event_type"), team.alias("team"), a.alias("from_player_id"), b.alias("to_player_id"))
    none, a, b = F.lit(None).cast("string"), F.col("from_id"), F.col("player_id")
    gained = event("RECOVERY", F.col("team"), none, b)
    kinds = F.when(a.isNull(), F.array(gained)).when(F.col("from_team") == F.col("team"), F.array(event("PASS", F.col("team"), a, b))).otherwise(F.array(event("BALL LOST", F.col("from_team"), a, none), gained))
    return t.select("match_id", "frame", F.explode(kinds).alias("e")).select("match_id", "frame", "e.*")
