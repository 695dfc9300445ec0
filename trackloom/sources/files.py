"""File sources and sinks: wide tracking CSV, annotated events CSV, nested JSON lines, canonical tables, results."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.scalars import finite, seconds
from trackloom.operators.validate import validate_tracking
from trackloom.schema import COLUMNS, TRACKING

EVENT_COLUMNS = ("match_id", "event_id", "period", "start_frame", "end_frame", "start_timestamp", "end_timestamp", "event_type", "event_subtype", "team", "from_player_id", "to_player_id", "start_x", "start_y", "end_x", "end_y")
FRAME_LINE = "frame long, timestamp string, period int, ball_data struct<x: double, y: double, z: double, is_detected: boolean>, player_data array<struct<x: double, y: double, player_id: long, is_detected: boolean>>"
FRAME_SECONDS = 0.10


def read_wide_tracking(spark: SparkSession, path: str, team: str, match_id: str) -> tuple[DataFrame, DataFrame]:
    """(players, ball) of a CSV with two lines before its header and X, Y pairs from the fourth column on.

    Only the header is read by the driver; rows are split and unpivoted by Spark.
    """
    lines = spark.read.text(path)
    names = [x.strip() for x in spark.read.text(path).limit(3).collect()[2].value.split(",")]
    at = {n: i for i, n in enumerate(names) if n and i >= 3}
    cells = F.split("value", ",")
    rows = lines.where(F.trim(F.get(cells, F.lit(1))).rlike(r"^\d+$")).withColumn("c", cells)
    number = lambda i: finite(F.expr(f"try_cast(trim(get(c, {i})) AS DOUBLE)"))
    spot = lambda i: F.struct(number(i).alias("x"), number(i + 1).alias("y"))
    head = [F.lit(match_id).alias("match_id"), F.trim(F.col("c")[1]).cast("long").alias("frame"), F.trim(F.col("c")[2]).cast("double").alias("timestamp")]
    people = F.array(*[F.struct(F.lit(n.removeprefix("Player")).alias("player_id"), spot(i).alias("at")) for n, i in at.items() if n.startswith("Player")])
    players = rows.select(*head, F.explode(people).alias("p")).select("match_id", "frame", "timestamp", "p.player_id", F.lit(team).alias("team"), F.col("p.at.x").alias("x"), F.col("p.at.y").alias("y"))
    seen = F.col("x").isNotNull() & F.col("y").isNotNull()
    players = players.select("match_id", "frame", "timestamp", "player_id", "team", F.when(seen, F.col("x")).alias("x"), F.when(seen, F.col("y")).alias("y"), seen.cast("double").alias("confidence"), seen.alias("visible"))
    ball = rows.select(*head, *([spot(at["Ball"]).alias("b")] if "Ball" in at else [F.lit(None).cast("struct<x: double, y: double>").alias("b")])).select("match_id", "frame", "timestamp", "b.x", "b.y")
    return players, ball


def load_match(spark: SparkSession, home_path: str, away_path: str, match_id: str) -> tuple[DataFrame, DataFrame]:
    """Tracking and ball of a match's two files; ValueError if their frames, times or ball differ."""
    home, ball = read_wide_tracking(spark, home_path, "home", match_id)
    away, other = read_wide_tracking(spark, away_path, "away", match_id)
    a = ball.select("frame", F.struct("timestamp", "x", "y").alias("a"))
    b = other.select("frame", F.struct("timestamp", "x", "y").alias("b"))
    near = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) | F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 1e-5, F.lit(False))
    apart = a.join(b, "frame", "full").where(F.col("a").isNull() | F.col("b").isNull() | ~(near("timestamp") & near("x") & near("y"))).count()
    if apart:
        raise ValueError(f"the two files differ in {apart} frames")
    tracking = home.unionByName(away)
    validate_tracking(tracking)
    return tracking, ball


def read_annotated_events(spark: SparkSession, path: str, match_id: str) -> DataFrame:
    """Annotated events in the canonical columns; event_id counts the file's rows by start frame and its own order."""
    raw = spark.read.csv(path, header=True, nullValue="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.withColumn("_at", F.monotonically_increasing_id()).coalesce(1)
    number = lambda c: finite(F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    team = F.lower("Team")
    end = number("End Frame")
    end = F.when((end > 0) & (end >= number("Start Frame")), end)

    def player(c: str):
        return F.when(F.col(c).isNotNull(), F.concat(F.when(team == "home", "HOME_").when(team == "away", "AWAY_").otherwise("UNKNOWN_"), F.regexp_replace(c, "^Player", "")))

    from pyspark.sql import Window

    return raw.select(
        F.lit(match_id).alias("match_id"),
        F.row_number().over(Window.orderBy("_at")).cast("long").alias("event_id"),
        F.col("Period").cast("int").alias("period"),
        F.col("Start Frame").cast("long").alias("start_frame"),
        end.alias("end_frame"),
        number("Start Time [s]").alias("start_timestamp"),
        F.when(end.isNotNull(), number("End Time [s]")).alias("end_timestamp"),
        F.col("Type").alias("event_type"),
        F.col("Subtype").alias("event_subtype"),
        team.alias("team"),
        player("From").alias("from_player_id"),
        player("To").alias("to_player_id"),
        *[number(c).alias(c.lower().replace(" ", "_")) for c in ("Start X", "Start Y", "End X", "End Y")],
    )


def read_frame_lines(spark: SparkSession, tracking_path: str, match_path: str, match_id: str) -> tuple[DataFrame, DataFrame]:
    """(players, ball) of JSON lines with metre coordinates from the pitch's centre and a JSON match file.

    Coordinates become (x + length / 2) / length, unclipped. A player who isn't in the match file
    raises an error when the rows are read.
    """
    match = json.loads("\n".join(r.value for r in spark.read.text(match_path, wholetext=True).collect()))
    length, width = float(match["pitch_length"]), float(match["pitch_width"])
    sides = {match["home_team"]["id"]: "home", match["away_team"]["id"]: "away"}
    roster = spark.createDataFrame([(int(p["id"]), sides.get(p["team_id"], "referee")) for p in match["players"]], "player_id long, team string")
    lines = spark.read.schema(FRAME_LINE).json(tracking_path)
    time = F.coalesce(seconds(F.col("timestamp")), F.col("frame") * FRAME_SECONDS)
    rows = lines.select(F.lit(match_id).alias("match_id"), "frame", time.alias("timestamp"), F.explode("player_data").alias("p"))
    rows = rows.select("match_id", "frame", "timestamp", "p.*").join(F.broadcast(roster), "player_id", "left")  # one match's roster
    known = F.when(F.col("team").isNull(), F.raise_error(F.concat(F.lit("unknown player "), F.col("player_id").cast("string")))).otherwise(F.col("team"))
    seen = F.coalesce("is_detected", F.lit(False))
    players = rows.select("match_id", "frame", "timestamp", F.col("player_id").cast("string").alias("player_id"), known.alias("team"), ((F.col("x") + length / 2) / length).alias("x"), ((F.col("y") + width / 2) / width).alias("y"), seen.cast("double").alias("confidence"), seen.alias("visible"))
    b = F.col("ball_data")
    ball = lines.select(F.lit(match_id).alias("match_id"), "frame", time.alias("timestamp"), ((b["x"] + length / 2) / length).alias("x"), ((b["y"] + width / 2) / width).alias("y"), b["z"].alias("z"), b["is_detected"].alias("visible"))
    return players, ball


def read_canonical(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Canonical tracking from Parquet or CSV, NaN as null."""
    reader = spark.read.schema(TRACKING)
    df = reader.csv(path, header=True) if kind == "csv" else reader.parquet(path)
    return df.withColumns({c: finite(F.col(c)) for c in ("timestamp", "x", "y", "confidence")})


def write_canonical(tracking: DataFrame, path: str, kind: str = "parquet") -> None:
    """Canonical columns, by match, so that a read of some matches opens only theirs."""
    out = tracking.select(*COLUMNS)
    if kind == "csv":
        out.write.mode("overwrite").csv(path, header=True)
    else:
        out.repartition("match_id").sortWithinPartitions("frame").write.mode("overwrite").parquet(path)


def write_results(results: DataFrame, folder: str) -> None:
    """The same rows as CSV and as JSON lines, non-finite numbers as null."""
    numbers = [f.name for f in results.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    safe = results.withColumns({c: finite(F.col(c)) for c in numbers}) if numbers else results
    safe.write.mode("overwrite").csv(f"{folder}/csv", header=True)
    safe.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/json")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON mapping; ValueError for anything else."""
    out = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()).lstrip("﻿"))
    if not isinstance(out, dict):
        raise ValueError("a configuration must be a mapping")
    return out


def _there(spark: SparkSession, path: str) -> bool:
    """Whether Spark's readers find the path, on whichever file system it lies."""
    try:
        spark.read.text(path)
        return True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def discover_match(spark: SparkSession, folder: str, match_id: str | int, prefix: str = "skillcorner_") -> tuple[DataFrame, DataFrame]:
    """read_frame_lines of a match in the folder or in its own folder below; FileNotFoundError if it is in neither.

    The id counts with or without the prefix, and the tables carry it with.
    """
    number = str(match_id).removeprefix(prefix)
    for place in (folder, f"{folder}/{number}"):
        lines = f"{place}/{number}_tracking_extrapolated.jsonl"
        if _there(spark, lines):
            return read_frame_lines(spark, lines, f"{place}/{number}_match.json", f"{prefix}{number}")
    raise FileNotFoundError(f"no match {number} in {folder}")


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored result (.csv with a header, .json as a list or an object), non-finite numbers as null; None where there is none."""
    if not _there(spark, path):
        return None
    df = spark.read.json(path, multiLine=True) if path.endswith(".json") else spark.read.csv(path, header=True, inferSchema=True)
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(F.col(f"`{c}`")) for c in numbers}) if numbers else df


def evaluation_summary(spark: SparkSession, results: dict[str, str]) -> DataFrame | None:
    """The rows of several stored results (name: path) as one table, with result, the name, and null where a result lacks a column.

    A result that isn't there is left out; None if none is.
    """
    found = {name: df for name, path in results.items() if (df := read_results(spark, path)) is not None}
    out = None
    for name, df in found.items():
        df = df.withColumn("result", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
