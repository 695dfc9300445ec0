"""The events table as canonical tracking and as reference events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.schema import COLUMNS

PLAYERS = 22


def tracking_from_events(events: DataFrame) -> DataFrame:
    """Each user a player of a match of 22 users, each of its events a frame; places are read before the events are sorted, so that these carry no text."""
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    seen = F.col("event_type") != "error"
    x = (F.round(F.col("value") * 100).cast("long") % 1000) / 1000.0
    y = F.get_json_object("props", "$.k").cast("int") / 100.0
    events = events.select("user_id", "ts", "event_id", "event_type", seen.alias("visible"), F.when(seen, x).alias("x"), F.when(seen, y).alias("y"))
    return events.select(
        F.floor(F.col("user_id") / PLAYERS).cast("string").alias("match_id"),
        frame.alias("frame"),
        (frame * 0.04).alias("timestamp"),
        F.col("user_id").cast("string").alias("player_id"),
        F.when(F.col("user_id") % 2 == 0, "home").otherwise("away").alias("team"),
        "x",
        "y",
        F.when(F.col("visible"), 1.0).otherwise(0.0).alias("confidence"),
        "visible",
        "event_type",
        "event_id",
    )


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).select(*COLUMNS)


def reference_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated events: match_id, event_id, start_frame, event_type."""
    named = F.when(F.col("event_type") == "purchase", "PASS").when(F.col("event_type") == "signup", "RECOVERY").when(F.col("event_type") == "click", "BALL LOST")
    t = tracking_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return t.where(named.isNotNull()).select("match_id", "event_id", F.col("frame").alias("start_frame"), named.alias("event_type"))
