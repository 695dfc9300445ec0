"""What an application asks of stored tracking: the catalogue, a frame's possessor and tactics, events, state vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import possession, serve, tactics
from trackloom.operators.pitch import near_players, team_shape
from trackloom.schema import FPS, FRAME

SIDES = ("home", "away")
SAMPLES = 1000


def catalogue(tracking: DataFrame, events: DataFrame) -> DataFrame:
    """A row per match of either table: label, fps, frame_count, tracking_available, events_available."""
    tracked = tracking.groupBy("match_id").agg(F.count_distinct("frame").alias("frame_count"))
    noted = events.select("match_id").distinct().withColumn("events_available", F.lit(True))
    both = tracked.join(noted, "match_id", "full")
    return both.select(
        "match_id",
        F.initcap(F.replace("match_id", F.lit("_"), F.lit(" "))).alias("label"),
        F.lit(FPS).alias("fps"),
        F.coalesce("frame_count", F.lit(0)).alias("frame_count"),
        F.col("frame_count").isNotNull().alias("tracking_available"),
        F.coalesce("events_available", F.lit(False)).alias("events_available"),
    )


def with_defaults(tracking: DataFrame) -> DataFrame:
    """Rows of the two sides; no confidence counts as 1, no visibility as visible."""
    sides = tracking.where(F.col("team").isin(*SIDES))
    return sides.withColumns({"confidence": F.coalesce(F.nanvl("confidence", F.lit(None).cast("double")), F.lit(1.0)), "visible": F.coalesce("visible", F.lit(True))})


def frame_possession(tracking: DataFrame) -> DataFrame:
    """Every frame's possessor by its own scores: status, possessor_id (SIDE_id), player_id, team, score.

    A frame without visible players of both sides is 'unavailable', with nulls.
    """
    sides = tracking.groupBy(*FRAME).agg((F.count_distinct(F.when(F.col("visible"), F.col("team"))) > 1).alias("both"))
    best = possession.memoryless(tracking).select(*FRAME, "team", "player_id", F.col("raw_score").alias("score"))
    t = sides.join(best, FRAME, "left").withColumn("fine", F.col("both") & F.col("player_id").isNotNull())
    shown = {"possessor_id": F.concat_ws("_", F.upper("team"), "player_id"), "player_id": F.col("player_id"), "team": F.col("team"), "score": F.col("score")}
    return t.select(*FRAME, F.when(F.col("fine"), "available").otherwise("unavailable").alias("status"), *[F.when(F.col("fine"), c).alias(n) for n, c in shown.items()])


def frame_tactics(tracking: DataFrame) -> DataFrame:
    """frame_possession with the possessor's features and tas; the direction of attack is unknown and left out of it."""
    held = frame_possession(tracking)
    own = held.select(*FRAME, F.col("player_id").alias("possessor_id"), "team")
    features = tactics.tactical_features(tracking, own, None).drop("possessor_id", "possessor_team", "forward_options")
    area = F.when(F.col("team") == "home", F.col("away_compactness_area")).otherwise(F.col("home_compactness_area"))
    score = tactics.advantage(F.col("possessor_pressure"), F.col("possessor_support"), area, F.lit(None).cast("long"))
    return held.join(features, FRAME, "left").withColumn("tas", F.when(F.col("status") == "available", score))


def possession_at(tracking: DataFrame, match_id: str, frame: int, reach: int = 25) -> DataFrame:
    """frame_possession of one frame, else of the nearest within reach; no row where there is none."""
    return frame_possession(serve.nearest_frame(tracking, match_id, frame, reach))


def tactics_at(tracking: DataFrame, match_id: str, frame: int, reach: int = 25) -> DataFrame:
    return frame_tactics(serve.nearest_frame(tracking, match_id, frame, reach))


def possession_range(tracking: DataFrame, match_id: str, first: int, last: int, stride: int = FPS) -> DataFrame:
    """Every stride-th tracked frame of a range and its last one, where a possessor is known.

    ValueError for a stride below 1, an empty range, or one that could give over SAMPLES rows.
    """
    if stride < 1 or last < first:
        raise ValueError("stride must be positive and the range not empty")
    if (last - first) // stride + 1 > SAMPLES:
        raise ValueError(f"more than {SAMPLES} samples; take a larger stride")
    own = tracking.where((F.col("match_id") == match_id) & F.col("frame").between(first, last))
    chosen = serve.sampled_frames(own.select(*FRAME).distinct(), stride)
    return frame_possession(own.join(chosen, FRAME, "left_semi")).where("status = 'available'").drop("status")


def metrics_at(metrics: DataFrame, tolerance: float) -> DataFrame:
    """The rows of precision_recall of exactly one tolerance, which is from 0.2 to 1 second."""
    if not 0.2 <= tolerance <= 1.0:
        raise ValueError("tolerance must be from 0.2 to 1 second")
    return metrics.where(F.col("tolerance") == tolerance)


def clip_summary(tracking: DataFrame, fewest: int = 4) -> DataFrame:
    """Per match: share of either side of the frames with a possessor (percent), and mean tas (0.5 if there is none).

    Frames with fewer rows than fewest don't count.
    """
    frames = tracking.groupBy(*FRAME).agg(F.count("*").alias("n")).where(F.col("n") >= fewest).drop("n")
    held = possession.memoryless(tracking).join(frames, FRAME, "left_semi").select(*FRAME, F.col("player_id").alias("possessor_id"), "team")
    scored = held.join(tactics.tactical_scores(tracking, held), FRAME)
    share = lambda side: F.round(100.0 * F.count_if(F.col("team") == side) / F.greatest(F.count_if(F.col("team").isin(*SIDES)), F.lit(1)), 1)
    sums = scored.groupBy("match_id").agg(*[share(s).alias(f"{s}_share") for s in SIDES], F.round(F.avg("tas"), 4).alias("mean_tas"), F.count("*").alias("frames"))
    return tracking.select("match_id").distinct().join(sums, "match_id", "left").fillna({"home_share": 0.0, "away_share": 0.0, "mean_tas": 0.5, "frames": 0})


def state_vector(tracking: DataFrame, support_radius: float = 12.0) -> DataFrame:
    """Nine features of each visible player, in metres, and the mean confidence of its frame.

    Without opponents nearest_opponent is null; forward_options is null, as no direction is known.
    """
    seen = tracking.where("visible")
    key = [*FRAME, "team", "player_id"]
    near = near_players(tracking, support_radius).select(*key, F.col("pressure").alias("pressure_index"), F.col("density").alias("local_density"), "support_count", "nearest_opponent")
    shape = team_shape(tracking).select(*FRAME, "team", F.col("width").alias("team_width"), F.col("length").alias("team_length"), "compactness", F.col("spread").alias("team_spread"))
    trust = F.coalesce(F.avg("confidence").over(Window.partitionBy(*FRAME)), F.lit(0.0))
    out = seen.select(*key, trust.alias("confidence")).join(near, key, "left").join(shape, [*FRAME, "team"])
    return out.fillna(0, ["pressure_index", "local_density", "support_count"]).withColumn("forward_options", F.lit(None).cast("long"))
