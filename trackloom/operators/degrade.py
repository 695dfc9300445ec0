"""Controlled tracking noise. Random draws are hashes of seed and key, so a table's partitioning changes nothing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.hashing import gaussian, uniform
from trackloom.functions.scalars import clip
from trackloom.schema import FRAME, TRACK

ROW = ("match_id", "team", "player_id", "frame")

# The severities.
SEVERITIES: dict[str, dict[str, float]] = {
    "clean": dict(missing_prob=0, gap_start_prob=0, gap_p_continue=0, gap_min_length=0, gap_max_length=0, jitter_scale=0, jump_prob=0, jump_magnitude_min=0, jump_magnitude_max=0, frag_prob=0, frag_num_splits=0, switch_prob=0, switch_duration_min=0, switch_duration_max=0),
    "mild": dict(missing_prob=0.02, gap_start_prob=0.001, gap_p_continue=0.08, gap_min_length=5, gap_max_length=25, jitter_scale=0.001, jump_prob=0.0002, jump_magnitude_min=0.05, jump_magnitude_max=0.15, frag_prob=0, frag_num_splits=0, switch_prob=0, switch_duration_min=0, switch_duration_max=0),
    "moderate": dict(missing_prob=0.08, gap_start_prob=0.005, gap_p_continue=0.03, gap_min_length=10, gap_max_length=75, jitter_scale=0.003, jump_prob=0.001, jump_magnitude_min=0.08, jump_magnitude_max=0.30, frag_prob=0.05, frag_num_splits=2, switch_prob=0.02, switch_duration_min=25, switch_duration_max=125),
    "severe": dict(missing_prob=0.20, gap_start_prob=0.010, gap_p_continue=0.01, gap_min_length=25, gap_max_length=250, jitter_scale=0.008, jump_prob=0.005, jump_magnitude_min=0.12, jump_magnitude_max=0.50, frag_prob=0.15, frag_num_splits=4, switch_prob=0.08, switch_duration_min=25, switch_duration_max=500),
}
NAMES = ("random_missing", "contiguous_gaps", "coordinate_jitter", "isolated_jumps", "track_fragmentation", "identity_switch")


def along():
    """A track in order of its frames."""
    return Window.partitionBy(*TRACK).orderBy("frame")


def _hide(tracking: DataFrame, rule: Column) -> DataFrame:
    return tracking.withColumn("_hide", F.coalesce(rule, F.lit(False))).withColumns(
        {
            "x": F.when(~F.col("_hide"), F.col("x")),
            "y": F.when(~F.col("_hide"), F.col("y")),
            "confidence": F.when(F.col("_hide"), 0.0).otherwise(F.col("confidence")),
            "visible": F.col("visible") & ~F.col("_hide"),
        }
    ).drop("_hide")


def random_missing(tracking: DataFrame, missing_prob: float = 0.05, seed: int = 42, teams: Iterable[str] | None = None, players: Iterable[str] | None = None) -> DataFrame:
    """Hides each row with the given probability, of all or some teams and players."""
    rule = uniform(seed, "missing", *ROW) < missing_prob
    if teams is not None:
        rule = rule & F.col("team").isin(*teams)
    if players is not None:
        rule = rule & F.col("player_id").isin(*players)
    return _hide(tracking, rule)


def contiguous_gaps(tracking: DataFrame, gap_start_prob: float, gap_p_continue: float, gap_min_length: int, gap_max_length: int, seed: int = 42) -> DataFrame:
    """Gaps begin at visible rows; lengths are geometric within bounds. A row is hidden if any gap begun so far reaches it."""
    if gap_start_prob <= 0 or gap_max_length <= 0:
        return tracking
    p = max(gap_p_continue, 1e-4) if gap_p_continue else 0.05
    length = F.ceil(F.log(1.0 - uniform(seed, "gap_length", *ROW)) / F.log(F.lit(1.0 - p)))
    length = F.least(F.greatest(length, F.lit(gap_min_length)), F.lit(gap_max_length))
    start = F.col("visible") & (uniform(seed, "gap_start", *ROW) < gap_start_prob)
    t = tracking.withColumn("_pos", F.row_number().over(along())).withColumn("_end", F.when(start, F.col("_pos") + length))
    return _hide(t.withColumn("_reach", F.max("_end").over(along())), F.col("_reach") > F.col("_pos")).drop("_pos", "_end", "_reach")


def noise(distribution: str, seed: int, tag: str, scale: float) -> Column:
    """Noise of standard deviation scale: gaussian, uniform or laplace, by the inverse of its distribution."""
    if distribution == "gaussian":
        return gaussian(seed, tag, *ROW) * scale
    u = uniform(seed, tag, *ROW)
    if distribution == "uniform":
        return (2.0 * u - 1.0) * (scale * 3**0.5)
    if distribution == "laplace":
        v = u - 0.5
        return -F.signum(v) * F.log(F.greatest(1.0 - 2.0 * F.abs(v), F.lit(1e-300))) * (scale / 2**0.5)
    raise ValueError(f"unknown distribution {distribution}")


def coordinate_jitter(tracking: DataFrame, scale: float, distribution: str = "gaussian", seed: int = 42, scale_x: float | None = None, scale_y: float | None = None) -> DataFrame:
    """Adds noise to the coordinates of visible rows."""
    sizes = {"x": scale if scale_x is None else scale_x, "y": scale if scale_y is None else scale_y}
    return tracking.withColumns({c: F.when(F.col("visible"), F.col(c) + noise(distribution, seed, f"jitter_{c}", s)).otherwise(F.col(c)) for c, s in sizes.items() if s > 0})


def isolated_jumps(tracking: DataFrame, jump_prob: float, magnitude_min: float, magnitude_max: float, seed: int = 42) -> DataFrame:
    """Moves some visible rows by a random length in a random direction."""
    jump = F.col("visible") & (uniform(seed, "jump", *ROW) < jump_prob)
    size = magnitude_min + uniform(seed, "jump_size", *ROW) * (magnitude_max - magnitude_min)
    angle = uniform(seed, "jump_angle", *ROW) * (2 * 3.141592653589793)
    return tracking.withColumns({"x": F.when(jump, F.col("x") + size * F.cos(angle)).otherwise(F.col("x")), "y": F.when(jump, F.col("y") + size * F.sin(angle)).otherwise(F.col("y"))})


def fragmentation(tracking: DataFrame, frag_prob: float, num_splits: int, seed: int = 42) -> DataFrame:
    """Cuts some tracks at num_splits places into <player_id>_frag_<k>."""
    if frag_prob <= 0 or num_splits <= 0:
        return tracking
    t = tracking.withColumns({"_pos": F.row_number().over(along()) - 1, "_n": F.count("*").over(Window.partitionBy(*TRACK))})
    t = t.withColumn("_h", F.when(F.col("_pos") > 0, uniform(seed, "frag_cut", *ROW)))
    t = t.withColumn("_cut", (F.row_number().over(Window.partitionBy(*TRACK).orderBy(F.asc_nulls_last("_h"), "frame")) <= num_splits) & (F.col("_pos") > 0))
    chosen = (uniform(seed, "frag", *TRACK) < frag_prob) & (F.col("_n") > num_splits)
    part = F.sum(F.col("_cut").cast("int")).over(along()).cast("string")
    return t.withColumn("_part", part).withColumn("player_id", F.when(chosen, F.concat("player_id", F.lit("_frag_"), "_part")).otherwise(F.col("player_id"))).drop("_pos", "_n", "_h", "_cut", "_part")


def identity_switch(tracking: DataFrame, switch_prob: float, duration_min: int, duration_max: int, seed: int = 42) -> DataFrame:
    """Pairs of teammates change labels over a stretch of their common frames.

    A change leaves the set of labels of a frame as it is, so all stretches are drawn from the input;
    a row's label then takes its frame's changes in order of the pairs.
    """
    if switch_prob <= 0 or duration_max <= 0:
        return tracking
    side = ["match_id", "team"]
    tracks = tracking.select(*TRACK).distinct()
    pairs = tracks.withColumnRenamed("player_id", "p1").join(tracks.withColumnRenamed("player_id", "p2"), side).where("p1 < p2").where(uniform(seed, "switch", *side, "p1", "p2") < switch_prob)
    rows = tracking.select(*TRACK, "frame")
    common = pairs.join(rows.withColumnRenamed("player_id", "p1"), [*side, "p1"]).join(rows.withColumnRenamed("player_id", "p2"), [*side, "p2", "frame"])
    pair = Window.partitionBy(*side, "p1", "p2")
    common = common.withColumns({"n": F.count("*").over(pair), "i": F.row_number().over(pair.orderBy("frame")) - 1})
    length = F.least(F.floor(duration_min + uniform(seed, "switch_length", *side, "p1", "p2") * (duration_max - duration_min + 1)), "n")
    common = common.where(F.col("n") >= duration_min).withColumn("length", length)
    common = common.withColumn("start", F.floor(uniform(seed, "switch_start", *side, "p1", "p2") * (F.col("n") - F.col("length") + 1)))
    active = common.where("i >= start AND i < start + length").groupBy(*side, "frame").agg(F.array_sort(F.collect_list(F.struct("p1", "p2"))).alias("swaps"))
    swapped = F.aggregate("swaps", F.col("player_id"), lambda label, s: F.when(label == s["p1"], s["p2"]).when(label == s["p2"], s["p1"]).otherwise(label))
    return tracking.join(active, [*side, "frame"], "left").withColumn("player_id", F.when(F.col("swaps").isNull(), F.col("player_id")).otherwise(swapped)).select(*tracking.columns)


def degrade(tracking: DataFrame, severity: str = "moderate", seed: int = 42, enabled: Iterable[str] = NAMES, custom: dict | None = None) -> DataFrame:
    """All kinds of noise of a severity in fixed order, each with its own seed; adds orig_player_id."""
    c = SEVERITIES[severity] | (custom or {})
    unknown = set(enabled) - set(NAMES)
    if unknown:
        raise ValueError(f"unknown degradations {sorted(unknown)}")
    out = tracking.withColumn("orig_player_id", F.col("player_id"))
    own = {n: seed * 10 + i for i, n in enumerate(NAMES)}
    if "random_missing" in enabled and c["missing_prob"] > 0:
        out = random_missing(out, c["missing_prob"], own["random_missing"])
    if "contiguous_gaps" in enabled:
        out = contiguous_gaps(out, c["gap_start_prob"], c["gap_p_continue"], c["gap_min_length"], c["gap_max_length"], own["contiguous_gaps"])
    if "coordinate_jitter" in enabled and c["jitter_scale"] > 0:
        out = coordinate_jitter(out, c["jitter_scale"], c.get("jitter_distribution", "gaussian"), own["coordinate_jitter"])
    if "isolated_jumps" in enabled and c["jump_prob"] > 0:
        out = isolated_jumps(out, c["jump_prob"], c["jump_magnitude_min"], c["jump_magnitude_max"], own["isolated_jumps"])
    if "track_fragmentation" in enabled:
        out = fragmentation(out, c["frag_prob"], c["frag_num_splits"], own["track_fragmentation"])
    if "identity_switch" in enabled:
        out = identity_switch(out, c["switch_prob"], c["switch_duration_min"], c["switch_duration_max"], own["identity_switch"])
    return out


def snapshot_noise(perturbation: str, severity: str) -> tuple[float, float]:
    """The scale of the jitter and the share of dropped players; availability is both, with half the share."""
    # Scale and share by severity.
    scale, share = {"mild": (0.001, 0.02), "moderate": (0.003, 0.08), "severe": (0.008, 0.20)}[severity]
    if perturbation not in ("jitter", "dropout", "availability"):
        raise ValueError(f"unknown perturbation {perturbation}")
    return 0.0 if perturbation == "dropout" else scale, {"jitter": 0.0, "dropout": share, "availability": share / 2}[perturbation]


def perturb_cells(states: DataFrame, cells: Column, seed: int) -> DataFrame:
    """A row per cell (cells: an array of structs with name, scale, share), as _cell: the players of each frame jittered by scale (clipped to the pitch) and thinned by exactly bround(n * share) rows.

    What is drawn of a row and its place in the frame's order of dropping are the same for all cells, so they are made before the rows are dealt to these.
    """
    frame = Window.partitionBy(*FRAME)
    drawn = states.withColumns({"_gx": gaussian(seed, "snap_x", *ROW), "_gy": gaussian(seed, "snap_y", *ROW), "_u": uniform(seed, "drop", *ROW)})
    drawn = drawn.withColumns({"_r": F.row_number().over(frame.orderBy("_u", *ROW)), "_n": F.count("*").over(frame)}).withColumn("_cell", F.explode(cells))
    scale = F.col("_cell.scale")
    moved = lambda c: F.when(scale > 0, clip(F.col(c) + F.col(f"_g{c}") * scale, 0, 1)).otherwise(F.col(c))
    out = drawn.where(F.col("_r") > F.bround(F.col("_n") * F.col("_cell.share"), 0))
    return out.withColumns({"x": moved("x"), "y": moved("y")}).drop("_gx", "_gy", "_u", "_r", "_n")


def noise_cell(name: str, perturbation: str, severity: str) -> Column:
    """A cell of perturb_cells."""
    return F.struct(F.lit(name).alias("name"), *[F.lit(float(v)).alias(n) for n, v in zip(("scale", "share"), snapshot_noise(perturbation, severity), strict=True)])


def perturb_snapshot(state: DataFrame, perturbation: str, severity: str, seed: int) -> DataFrame:
    """One frame's players jittered (clipped to the pitch), thinned, or both; drops exactly bround(n * p) of a frame's rows."""
    return perturb_cells(state, F.array(noise_cell(perturbation, perturbation, severity)), seed).drop("_cell")


def check_config(config: dict) -> dict:
    """The configuration, if it holds every key that degrade reads; else ValueError with those that it lacks."""
    missing = {*SEVERITIES["clean"], "jitter_distribution"} - config.keys()
    if missing:
        raise ValueError(f"the configuration lacks {sorted(missing)}")
    return config
