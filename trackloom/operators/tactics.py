"""Tactical features of a frame and the situational advantage score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalars import clip
from trackloom.operators.graph import apart, field, frame_players, others, team_is
from trackloom.schema import FRAME, tracking_only

SUPPORT_RADIUS = 0.15


def _geometry() -> list[Column]:
    """Columns of the array players: centroid, width, length and area of home and away."""
    columns = []
    for team in ("home", "away"):
        own = F.filter("players", team_is(team))
        values = {c: F.transform(own, field(c)) for c in ("x", "y")}
        centre = {c: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(own), F.lit(0)) for c, v in values.items()}
        width, length = (F.array_max(values[c]) - F.array_min(values[c]) for c in ("y", "x"))
        columns += [centre["x"].alias(f"{team}_centroid_x"), centre["y"].alias(f"{team}_centroid_y"), width.alias(f"{team}_width"), length.alias(f"{team}_length"), (width * length).alias(f"{team}_compactness_area")]
    return columns


def team_geometry(tracking: DataFrame) -> DataFrame:
    """A row per frame with visible players: centroid, width, length and area of home and away; null for a team without players."""
    return frame_players(tracking).where(F.size("players") > 0).select(*FRAME, *_geometry())


def tactical_features(tracking: DataFrame, possession: DataFrame, home_attacks_x1: bool | None = True) -> DataFrame:
    """Geometry and the possessor's pressure, support and forward options for each frame of possession.

    possession: match_id, frame, possessor_id, team. No possessor: pressure and support null, no
    forward options; an unknown direction: forward options null.
    """
    tracking = tracking_only(tracking)
    own = possession.select(*FRAME, "possessor_id", F.col("team").alias("possessor_team"))
    both = own.join(frame_players(tracking), FRAME, "left")
    seen = F.filter("players", lambda q: (q["team"] == F.col("possessor_team")) & (q["player_id"] == F.col("possessor_id")))
    both = both.select("*", F.explode_outer(F.slice(seen, 1, 1)).alias("me"))
    me = F.col("me")
    mates, foes = others(me, True), others(me, False)
    forward = F.lit(None).cast("long")
    if home_attacks_x1 is not None:
        way = F.when((F.col("possessor_team") == "home") == F.lit(home_attacks_x1), 1.0).otherwise(-1.0)
        forward = F.coalesce(F.size(F.filter(mates, lambda q: way * (q["x"] - me["x"]) > 0)).cast("long"), F.lit(0))
    support = F.size(F.filter(mates, lambda q: (apart(me, q) > 0) & (apart(me, q) <= SUPPORT_RADIUS))).cast("long")
    some, here = F.col("possessor_id").isNotNull(), me.isNotNull()
    out = both.select(*FRAME, "possessor_id", "possessor_team", *_geometry(), F.when(here, F.array_min(F.transform(foes, lambda q: apart(me, q)))).alias("possessor_pressure"),
        F.when(some, F.when(here, support).otherwise(0)).alias("possessor_support"), F.when(here, forward).otherwise(forward if home_attacks_x1 is None else F.lit(0)).alias("forward_options"))
    return out


def advantage(pressure: Column, support: Column, opponent_area: Column, forward: Column) -> Column:
    """The score in [0, 1]; a null forward leaves its weight out, a null pressure counts as 0, a null area as 1."""
    base = 0.35 * clip(F.coalesce(pressure, F.lit(0.0)) / 0.3, 0, 1) + 0.15 * clip(F.coalesce(support, F.lit(0)) / 3.0, 0, 1) + 0.15 * F.when(opponent_area.isNull(), 1.0).otherwise(clip(opponent_area / 0.4, 0, 1))
    return clip(F.when(forward.isNull(), base / 0.65).otherwise(base + 0.35 * clip(forward / 4.0, 0, 1)), 0, 1)


def tactical_scores(tracking: DataFrame, possession: DataFrame, home_attacks_x1: bool | None = True) -> DataFrame:
    """match_id, frame, tas; 0 where no team has the ball."""
    f = tactical_features(tracking, possession, home_attacks_x1)
    area = F.when(F.col("possessor_team") == "home", F.col("away_compactness_area")).otherwise(F.col("home_compactness_area"))
    score = advantage(F.col("possessor_pressure"), F.col("possessor_support"), area, F.col("forward_options"))
    return f.select(*FRAME, F.when(F.col("possessor_team").isNull(), 0.0).otherwise(score).alias("tas"))
