"""The canonical tracking table and the constants of inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRACKING = T.StructType(
    [
        T.StructField("match_id", T.StringType()),
        T.StructField("frame", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("player_id", T.StringType()),
        T.StructField("team", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("visible", T.BooleanType()),
    ]
)
COLUMNS = tuple(TRACKING.fieldNames())
FRAME = ["match_id", "frame"]
TRACK = ["match_id", "team", "player_id"]
FPS = 25


def tracking_only(df: DataFrame) -> DataFrame:
    """The whitelisted columns and nothing else: inference must not see the ball, labels or any other column."""
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"tracking lacks {missing}")
    return df.select(*COLUMNS)
