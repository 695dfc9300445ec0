"""Tables for point lookups: the latest rows, samples of a timeline, frames as nested rows, team colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import colour_name
from trackloom.schema import FRAME, TRACK


def latest_rows(tracking: DataFrame) -> DataFrame:
    """The last visible row of each player."""
    last = Window.partitionBy(*TRACK).orderBy(F.desc("frame"))
    return tracking.where("visible").withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def trajectory(tracking: DataFrame, match_id: str, player_id: str, limit: int = 200) -> DataFrame:
    """The first rows of a player, at least one and at most 1000."""
    own = tracking.where((F.col("match_id") == match_id) & (F.col("player_id") == player_id))
    return own.orderBy("frame").limit(min(max(limit, 1), 1000))


def sampled_frames(timeline: DataFrame, stride: int) -> DataFrame:
    """Every stride-th frame of each match, and its last one."""
    order = Window.partitionBy("match_id").orderBy("frame")
    t = timeline.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("match_id"))})
    return t.where(((F.col("_r") - 1) % stride == 0) | (F.col("_r") == F.col("_n"))).drop("_r", "_n")


def frame_map(tracking: DataFrame) -> DataFrame:
    """A row per frame with its players as an array of structs, in order of team and id."""
    return tracking.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("team", "player_id", "x", "y", "visible"))).alias("players"))


def nearest_frame(tracking: DataFrame, match_id: str, frame: int, reach: int = 25) -> DataFrame:
    """The rows of the frame, else of the nearest one within reach frames (the earlier if two are)."""
    own = tracking.where((F.col("match_id") == match_id) & F.col("frame").between(frame - reach, frame + reach))
    best = own.select("frame").distinct().orderBy(F.abs(F.col("frame") - frame), "frame").limit(1)
    return own.join(best, "frame", "left_semi")


def team_modes(tracking: DataFrame, column: str) -> DataFrame:
    """The most frequent value of a column per match and team, the least if several are."""
    n = tracking.where(F.col(column).isNotNull()).groupBy("match_id", "team", column).agg(F.count("*").alias("n"))
    first = Window.partitionBy("match_id", "team").orderBy(F.desc("n"), column)
    return n.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def team_colours(tracking: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """team_modes of jersey_color where it is a colour, else the team's default, with its name."""
    fine = tracking.withColumn("jersey_color", F.when(F.lower("jersey_color").rlike("^#[0-9a-f]{6}$"), F.lower("jersey_color")))
    teams = tracking.select("match_id", "team").distinct().join(team_modes(fine, "jersey_color").drop("n"), ["match_id", "team"], "left")
    default = F.lit(None).cast("string")
    for team, colour in defaults.items():
        default = F.when(F.col("team") == team, colour).otherwise(default)
    return teams.withColumn("colour", F.coalesce("jersey_color", default)).withColumn("name", colour_name(F.col("colour"))).drop("jersey_color")
