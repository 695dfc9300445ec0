"""Measures of tracking quality, coordinate errors and stability against a clean reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import distance
from trackloom.operators.repair import candidate_cuts, gap_runs
from trackloom.schema import FRAME, TRACK


def with_steps(tracking: DataFrame) -> DataFrame:
    """Visible rows with step: the distance from the track's row at frame - 1, null if that isn't visible."""
    order = Window.partitionBy(*TRACK).orderBy("frame")
    d = distance(F.col("x"), F.col("y"), F.lag("x").over(order), F.lag("y").over(order))
    return tracking.where("visible").withColumn("step", F.when(F.lag("frame").over(order) == F.col("frame") - 1, d))


def tracking_quality(tracking: DataFrame, large_motion: float = 0.05, expected_players: int | None = None) -> DataFrame:
    """Per match: missingness, completeness, validity, interpolated share, adjacent steps, anomalies and their rate."""
    imputed = F.avg(F.col("imputed").cast("double")) if "imputed" in tracking.columns else F.lit(0.0)
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1)
    rows = tracking.groupBy("match_id").agg(
        (1.0 - F.avg(F.col("visible").cast("double"))).alias("missingness"),
        F.count_if("visible").alias("seen"),
        F.count_distinct("frame").alias("frames"),
        F.count_distinct("team", "player_id").alias("roster"),
        F.count_if(F.col("visible") & inside).alias("valid"),
        imputed.alias("interpolation_fraction"),
    )
    steps = with_steps(tracking).groupBy("match_id").agg(F.count("step").alias("adjacent_steps"), F.count_if(F.col("step") > large_motion).alias("motion_anomalies"))
    out = rows.join(steps, "match_id", "left").fillna(0, ["adjacent_steps", "motion_anomalies"])
    expected = F.lit(expected_players) if expected_players else F.col("roster")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select(
        "match_id",
        "missingness",
        safe(F.col("seen"), F.col("frames") * expected).alias("completeness"),
        safe(F.col("valid"), F.col("seen")).alias("coordinate_validity"),
        "interpolation_fraction",
        "adjacent_steps",
        "motion_anomalies",
        safe(F.col("motion_anomalies"), F.col("adjacent_steps")).alias("anomaly_rate"),
    )


def extended_quality(tracking: DataFrame) -> DataFrame:
    """tracking_quality with gap runs, continuity, displacement and stability of speeds, and candidate cuts.

    Speeds come in order of team, player and frame; their differences run within a track, those of
    the accelerations across tracks.
    """
    gaps = gap_runs(tracking).where("NOT visible").groupBy("match_id").agg(F.count("*").alias("gap_count"), F.avg("length").alias("mean_gap_length"), F.max("length").alias("max_gap_length"))
    steps = with_steps(tracking).where("step IS NOT NULL")
    track, match = Window.partitionBy(*TRACK).orderBy("frame"), Window.partitionBy("match_id").orderBy("team", "player_id", "frame")
    speed = steps.withColumn("speed", F.col("step") / 0.04)
    speed = speed.withColumn("a", F.col("speed") - F.lag("speed").over(track))
    moves = speed.groupBy("match_id").agg(F.count("*").alias("steps"), F.avg("step").alias("mean_displacement"), F.percentile("step", F.lit(0.95)).alias("p95_displacement"), F.stddev_pop("a").alias("velocity_stability"))
    jerk = speed.where("a IS NOT NULL").withColumn("j", F.col("a") - F.lag("a").over(match)).groupBy("match_id").agg(F.stddev_pop("j").alias("acceleration_stability"))
    size = tracking.groupBy("match_id").agg(F.greatest(F.count("*") - F.count_distinct("frame"), F.lit(1)).alias("room"))
    cuts = candidate_cuts(tracking).groupBy("match_id").agg(F.count_if("candidate_cut").alias("candidate_cut_count"))
    out = tracking_quality(tracking)
    for other in (gaps, moves, jerk, size, cuts):
        out = out.join(other, "match_id", "left")
    out = out.withColumn("trajectory_continuity", F.coalesce(F.col("steps") / F.col("room"), F.lit(0.0))).drop("steps", "room")
    return out.fillna(0, [c for c in out.columns if c != "match_id"])


def api_quality(tracking: DataFrame) -> DataFrame:
    """A row per track: observed frames, coverage and gaps in steps of the match's usual frame distance; with the match's sums."""
    seen = tracking.where("visible")
    frames = seen.select(*FRAME).distinct()
    lag = F.col("frame") - F.lag("frame").over(Window.partitionBy("match_id").orderBy("frame"))
    step = frames.withColumn("d", lag).groupBy("match_id").agg(F.greatest(F.coalesce(F.floor(F.percentile("d", F.lit(0.5))), F.lit(1)), F.lit(1)).alias("frame_step"), F.count("*").alias("frame_count"))
    rows = seen.select(*TRACK, "frame").distinct().join(step, "match_id")
    before = F.lag("frame").over(Window.partitionBy(*TRACK).orderBy("frame"))
    rows = rows.withColumn("gap", F.greatest(F.bround((F.col("frame") - before) / F.col("frame_step"), 0) - 1, F.lit(0)).cast("long"))
    expected = F.greatest(F.bround((F.max("frame") - F.min("frame")) / F.col("frame_step"), 0) + 1, F.lit(1))
    return rows.groupBy(*TRACK, "frame_step", "frame_count").agg(
        F.count("*").alias("observed_frames"),
        F.round(F.least(F.lit(1.0), F.count("*") / expected), 4).alias("active_frame_coverage"),
        F.count_if(F.col("gap") > 0).alias("gap_count"),
        (F.coalesce(F.max("gap"), F.lit(0)) * F.col("frame_step")).alias("longest_gap_frames"),
    )


def aligned(clean: DataFrame, test: DataFrame, player: str = "player_id") -> DataFrame:
    """Rows of both tables by match, frame, team and the original player.

    Both are rows of tracking, which are never sent whole to every task, however small their files make Spark take them for.
    """
    a = clean.select("match_id", "frame", "team", F.col("player_id").alias("_p"), F.col("x").alias("x_clean"), F.col("y").alias("y_clean"), F.col("visible").alias("visible_clean"))
    b = test.withColumn("_p", F.col(player)).drop("timestamp")
    return a.hint("merge").join(b, ["match_id", "frame", "team", "_p"])


def coordinate_errors(clean: DataFrame, test: DataFrame, player: str = "player_id", by: Sequence[str] = ()) -> DataFrame:
    """Per match: percent missing, RMSE and mean absolute error of the points that both have, jitter of the test's speed.

    by: columns of test that tell tables of one match apart, such as a way of repair, of few values; each match has a row
    for each of these, and clean's rows are held against all of them in one join.
    """
    keys = [*by, "match_id"]
    both = aligned(clean, test, player)
    d = distance(F.col("x"), F.col("y"), F.col("x_clean"), F.col("y_clean"))
    errors = both.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("coord_rmse"), F.avg(d).alias("coord_mae"))
    total = clean.groupBy("match_id").agg(F.count("*").alias("expected"))
    if by:
        total = total.crossJoin(F.broadcast(test.select(*by).distinct()))
    seen = test.groupBy(*keys).agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("observed"))
    out = total.join(seen, keys, "left").join(errors, keys, "left").join(velocity_jitter(test, by), keys, "left")
    missing = 100.0 * (1.0 - F.coalesce("observed", F.lit(0)) / F.greatest("expected", F.lit(1)))
    return out.select(*keys, F.round(missing, 2).alias("missing_pct"), *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("coord_rmse", "coord_mae", "velocity_jitter")])


def velocity_jitter(tracking: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sample standard deviation of the distance to a track's row before, whatever the frames."""
    order = Window.partitionBy(*by, *TRACK).orderBy("frame")
    v = distance(F.col("x"), F.col("y"), F.lag("x").over(order), F.lag("y").over(order))
    return tracking.withColumn("v", v).groupBy(*by, "match_id").agg(F.stddev_samp("v").alias("velocity_jitter"))


def kinematics(tracking: DataFrame, metres: float = 85.0) -> DataFrame:
    """Per match: mean, median and 95th percentile of speed by row difference, and the visible share."""
    order = Window.partitionBy(*TRACK).orderBy("frame")
    speed = distance(F.col("x"), F.col("y"), F.lag("x").over(order), F.lag("y").over(order)) / (F.col("timestamp") - F.lag("timestamp").over(order)) * metres
    return tracking.withColumn("speed", speed).groupBy("match_id").agg(
        F.avg("speed").alias("mean_speed"), F.percentile("speed", F.lit(0.5)).alias("median_speed"), F.percentile("speed", F.lit(0.95)).alias("p95_speed"), F.avg(F.col("visible").cast("double")).alias("coverage")
    )


def degradation_statistics(clean: DataFrame, degraded: DataFrame) -> DataFrame:
    """Per match: percent missing, gap lengths, displacement of the points that both have, changed labels."""
    both = aligned(clean, degraded, "orig_player_id")
    d = distance(F.col("x"), F.col("y"), F.col("x_clean"), F.col("y_clean"))
    moved = both.groupBy("match_id").agg(
        (100.0 * (1.0 - F.avg(F.col("visible").cast("double")))).alias("missing_pct"),
        F.avg(d).alias("perturbation_mean"),
        F.stddev_samp(d).alias("perturbation_std"),
        F.max(d).alias("perturbation_max"),
        F.count_if(F.col("player_id") != F.col("_p")).alias("relabelled_rows"),
    )
    gaps = gap_runs(degraded).where("NOT visible").groupBy("match_id")
    at = lambda p: F.percentile("length", F.lit(p))
    gaps = gaps.agg(F.avg("length").alias("gap_mean"), at(0.5).alias("gap_median"), at(0.95).alias("gap_p95"), at(0.99).alias("gap_p99"), F.max("length").alias("gap_max"))
    return moved.join(gaps, "match_id", "left")


def _top(order: Column, k: int) -> Column:
    return F.row_number().over(Window.partitionBy("match_id").orderBy(order, "frame")) <= F.least(F.lit(k), F.col("n"))


def tactical_stability(clean: DataFrame, other: DataFrame, timeline: DataFrame, top_k: int = 10) -> DataFrame:
    """Per match, of scores (match_id, frame, tas) against the clean ones: errors, correlation, top-k overlap,
    mean over the clean possession's segments of their mean error."""
    both = clean.withColumnRenamed("tas", "a").join(other.withColumnRenamed("tas", "b"), FRAME).join(timeline.select(*FRAME, "possessor_id"), FRAME)
    both = both.withColumn("d", F.abs(F.col("b") - F.col("a"))).withColumn("n", F.count("*").over(Window.partitionBy("match_id")))
    order = Window.partitionBy("match_id").orderBy("frame")
    fresh = (~F.col("possessor_id").eqNullSafe(F.lag("possessor_id").over(order)) | (F.row_number().over(order) == 1)).cast("int")
    both = both.withColumns({"top_a": _top(F.desc("a"), top_k), "top_b": _top(F.desc("b"), top_k), "fresh": fresh}).withColumn("segment", F.sum("fresh").over(order))
    segments = both.where("possessor_id IS NOT NULL").groupBy("match_id", "segment").agg(F.avg("d").alias("m")).groupBy("match_id").agg(F.avg("m").alias("segment_stability"))
    out = both.groupBy("match_id").agg(
        F.count("*").alias("n_frames"),
        F.avg("d").alias("mean_error"),
        F.percentile("d", F.lit(0.5)).alias("median_error"),
        F.when((F.count_distinct("a") > 1) & (F.count_distinct("b") > 1), F.corr("a", "b")).alias("correlation"),
        (F.count_if(F.col("top_a") & F.col("top_b")) / F.least(F.lit(top_k), F.count("*"))).alias("top_k_agreement"),
    )
    return out.join(segments, "match_id", "left")
