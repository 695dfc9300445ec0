"""Tracklets of a video to tracks: stitching, one row a frame, squads, filling and smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import clip
from trackloom.operators.pitch import stitch_tracklets
from trackloom.operators.repair import fit_rows
from trackloom.schema import FPS, FRAME, TRACK, TRACKING

SIDE = ["match_id", "team"]
# Where officials stand, and the confidence of a filled frame and of a player never seen.
OUTSIDE = dict(x=0.015, y=0.035)
FILLED, UNSEEN = 0.75, 0.60
# Where the players 1 to 11 of the side that defends the left stand if never seen; the other side is this turned about.
PLACES = ((0.04, 0.50), (0.18, 0.20), (0.16, 0.40), (0.16, 0.60), (0.18, 0.80), (0.35, 0.32), (0.35, 0.68), (0.42, 0.50), (0.55, 0.22), (0.58, 0.50), (0.55, 0.78))


def chained(tracking: DataFrame, fps: int = FPS, **stitching) -> DataFrame:
    """The seen rows with player_id that of their chain, one row a frame: of overlapping tracklets that which began first.

    Tracklets of one row go, and those of officials, whose median place is on a line or beyond it.
    """
    seen = tracking.where("visible AND x IS NOT NULL AND y IS NOT NULL")
    at = lambda pick, c: pick(F.struct("frame", "x", "y"))[c]
    middle = lambda c: F.percentile(c, F.lit(0.5))
    inside = lambda c: (F.col(f"_{c}") > OUTSIDE[c]) & (F.col(f"_{c}") < 1 - OUTSIDE[c])
    pieces = seen.groupBy(*TRACK).agg(
        F.count("*").alias("_n"), middle("x").alias("_x"), middle("y").alias("_y"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), *[at(f, c).alias(f"{name}_{c}") for f, name in ((F.min, "first"), (F.max, "last")) for c in ("x", "y")]
    )
    pieces = pieces.where((F.col("_n") >= 2) & inside("x") & inside("y")).drop("_n", "_x", "_y")
    chains = stitch_tracklets(pieces, fps=fps, **stitching).select(*TRACK, "first_frame", "stitched_id")
    rows = seen.join(chains, TRACK).withColumnRenamed("player_id", "_piece").withColumnRenamed("stitched_id", "player_id")
    first = Window.partitionBy(*TRACK, "frame").orderBy("first_frame", "_piece")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*TRACKING.names)


def spans(tracking: DataFrame, total_frames: int) -> DataFrame:
    """match_id, frame: all frames of each match from 0 to its last, total_frames of them at least."""
    last = tracking.groupBy("match_id").agg(F.greatest(F.max("frame"), F.lit(total_frames - 1)).alias("_last"))
    return last.select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("frame"))


def on_frames(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Each track on each of its match's frames; a and b are its nearest seen rows up to and from there."""
    t = rows.select(*TRACK).distinct().join(frames, "match_id").join(rows.select(*TRACK, "frame", "x", "y", "confidence"), [*TRACK, "frame"], "left")
    order = Window.partitionBy(*TRACK).orderBy("frame")
    seen = F.when(F.col("x").isNotNull(), F.struct("frame", "x", "y", "confidence"))
    return t.withColumns({"a": F.last(seen, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(seen, True).over(order.rowsBetween(0, Window.unboundedFollowing))})


def between(c: str) -> Column:
    """On the line from a to b, at their own place where they are one row; null before a or after b."""
    part = F.when(F.col("b.frame") > F.col("a.frame"), (F.col("frame") - F.col("a.frame")) / (F.col("b.frame") - F.col("a.frame"))).otherwise(0.0)
    return F.col(f"a.{c}") + part * (F.col(f"b.{c}") - F.col(f"a.{c}"))


def timed(rows: DataFrame, fps: int) -> DataFrame:
    return rows.withColumn("timestamp", F.round(F.col("frame") / float(max(fps, 1)), 4)).select(*TRACKING.names, *[c for c in ("imputed",) if c in rows.columns])


def smoothed(c: str, size: int = 9) -> Column:
    """c smoothed by a parabola through size frames of a dense track; the ends take the fit to its first or last frames. Shorter tracks stay."""
    fit, half = fit_rows(size, 2), size // 2
    track = Window.partitionBy(*TRACK)
    order = track.orderBy("frame")
    i, n = F.row_number().over(order) - 1, F.count("*").over(track)
    inner = sum((float(fit[half, j]) * (F.lead(c, j - half).over(order) if j > half else F.lag(c, half - j).over(order) if j < half else F.col(c)) for j in range(size)), F.lit(0.0))
    last = F.max("frame").over(track)
    some = lambda near: F.transform(F.array_sort(F.collect_list(F.when(near, F.struct("frame", c))).over(track)), lambda v: v[c])
    head, tail = some(F.col("frame") < F.min("frame").over(track) + size), some(F.col("frame") > last - size)
    at = lambda values, row: F.aggregate(F.zip_with(values, F.get(F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in fit]), row), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.when(n < size, F.col(c)).when(i < half, at(head, i)).when(i >= n - half, at(tail, (i - n + size).cast("int"))).otherwise(inner)


def bridge_tracks(tracking: DataFrame, max_gap: int = 10, total_frames: int = 0, fps: int = FPS, **stitching) -> DataFrame:
    """Chained tracks with their gaps of up to max_gap frames filled; longer ones and the ends stay out. All rows are visible."""
    t = on_frames(chained(tracking, fps, **stitching), spans(tracking, total_frames))
    t = t.where(F.col("x").isNotNull() | (F.col("b.frame") - F.col("a.frame") - 1 <= max_gap))
    return timed(t.select(*FRAME, "player_id", "team", between("x").alias("x"), between("y").alias("y"), between("confidence").alias("confidence"), F.lit(True).alias("visible")), fps)


def squads(tracking: DataFrame, max_gap: int = 10, min_observations: int = 8, total_frames: int = 0, fps: int = FPS, **stitching) -> DataFrame:
    """Eleven players a side on every frame: the chains with most observations times mean confidence, named SIDE_1 to SIDE_11.

    A side is one with a chain of min_observations rows. Of a match's sides home, else the first by name,
    defends the left. Gaps and ends of a chain are filled, and a place without a chain stands
    where PLACES has it; imputed tells both. Positions are smoothed (9 frames, parabola) and kept on the pitch.
    """
    rows = chained(tracking, fps, **stitching)
    best = rows.groupBy(*TRACK).agg(F.count("*").alias("n"), (F.count("*") * F.avg("confidence")).alias("score")).where(F.col("n") >= min_observations)
    best = best.withColumn("number", F.row_number().over(Window.partitionBy(*SIDE).orderBy(F.desc("score"), "player_id"))).where("number <= 11")
    sides = best.select(*SIDE).distinct().withColumn("left", F.row_number().over(Window.partitionBy("match_id").orderBy(F.col("team") != "home", "team")) == 1)
    name = F.concat(F.replace(F.upper("team"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("number"))
    frames = spans(tracking, total_frames)
    kept = rows.join(best.select(*TRACK, "number"), TRACK)
    found = on_frames(kept.withColumn("player_id", name), frames)
    filled = lambda c: F.coalesce(between(c), F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    found = found.select(*FRAME, "player_id", "team", filled("x"), filled("y"), F.when(F.col("x").isNull(), FILLED).otherwise(F.coalesce("confidence", F.lit(FILLED))).alias("confidence"), F.col("x").isNull().alias("imputed"))
    places = F.array(*[F.struct(F.lit(i + 1).alias("number"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(PLACES)])
    turned = lambda v: F.when(F.col("left"), v).otherwise(1.0 - v)
    empty = sides.withColumn("p", F.explode(places)).select(*SIDE, "left", "p.*").join(best.select(*SIDE, "number"), [*SIDE, "number"], "left_anti")
    empty = empty.join(frames, "match_id").select(*FRAME, name.alias("player_id"), "team", turned(F.col("x")).alias("x"), turned(F.col("y")).alias("y"), F.lit(UNSEEN).alias("confidence"), F.lit(True).alias("imputed"))
    whole = found.unionByName(empty).withColumns({"visible": F.lit(True), "timestamp": F.lit(0.0)})
    return timed(whole.withColumns({c: clip(smoothed(c), 0.005, 0.995) for c in ("x", "y")}), fps)
