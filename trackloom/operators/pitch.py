"""Measures in metres (105 by 68) for displays, deterministic noise, and projections of image points."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackloom.functions.hashing import fnv_unit, uniform
from trackloom.functions.scalars import clip
from trackloom.operators.graph import frame_pairs
from trackloom.schema import FRAME, TRACK

LENGTH, WIDTH = 105.0, 68.0


def metres(tracking: DataFrame) -> DataFrame:
    return tracking.withColumns({"x": F.col("x") * LENGTH, "y": F.col("y") * WIDTH})


def near_players(tracking: DataFrame, support_radius: float = 12.0) -> DataFrame:
    """Per visible player with neighbours, in metres, of one pass over its frame's pairs: pressure by opponents, support
    by teammates, players within 10 m (density), teammates within support_radius (support_count), nearest_opponent.
    """
    near = lambda same, reach, full: F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col("same_team") == same, F.exp(-F.col("dist") / reach))), F.lit(0.0)) / full)
    pairs = frame_pairs(metres(tracking)).groupBy(*FRAME, F.col("src_team").alias("team"), F.col("src_id").alias("player_id"))
    return pairs.agg(
        near(False, 6.0, 2.4).alias("pressure"),
        near(True, 12.0, 4.2).alias("support"),
        F.count_if(F.col("dist") <= 10).alias("density"),
        F.count_if(F.col("same_team") & (F.col("dist") <= support_radius)).alias("support_count"),
        F.min(F.when(~F.col("same_team"), F.col("dist"))).alias("nearest_opponent"),
    )


def pressure_support(tracking: DataFrame) -> DataFrame:
    """Per visible player with neighbours: pressure by opponents, support by teammates, players within 10 m."""
    return near_players(tracking).drop("support_count", "nearest_opponent")


def team_shape(tracking: DataFrame) -> DataFrame:
    """Per frame and team: centroid, width, length, mean distance to the centroid and compactness."""
    seen = metres(tracking).where("visible")
    team = Window.partitionBy(*FRAME, "team")
    seen = seen.withColumns({"cx": F.avg("x").over(team), "cy": F.avg("y").over(team)})
    spread = F.avg(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)))
    out = seen.groupBy(*FRAME, "team").agg(F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), (F.max("y") - F.min("y")).alias("width"), (F.max("x") - F.min("x")).alias("length"), spread.alias("spread"))
    return out.withColumn("compactness", 1.0 / (1.0 + F.col("spread") / 12.0))


def display_pass_score(candidates: DataFrame) -> DataFrame:
    """.34 space + .26 (1 - pressure) + .22 (1 - obstruction) + .18 (progress + .5) of pass candidates."""
    space, pressure = clip(F.col("target_space") / 0.3, 0, 1), 1.0 - clip(F.col("target_pressure") / 0.3, 0, 1)
    score = 0.34 * space + 0.26 * (1.0 - pressure) + 0.22 * (1.0 - clip(F.col("obstruction") / 3.0, 0, 1)) + 0.18 * (clip(F.col("forward_progress"), -0.5, 0.5) + 0.5)
    return candidates.withColumn("display_score", score)


def forward_mates(candidates: DataFrame, least: float = 3.0 / LENGTH, k: int = 6) -> DataFrame:
    """The k nearest teammates that are ahead by more than 3 m."""
    near = Window.partitionBy(*FRAME, "team", "source_player_id").orderBy("distance", "target_player_id")
    return candidates.where(F.col("forward_progress") > least).withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k).drop("_r")


def display_velocity(tracking: DataFrame, fps: int = 25) -> DataFrame:
    """Velocity in metres a second to the row at frame + 1; none below 0.04 m, at most 9.45."""
    track = Window.partitionBy(*TRACK).orderBy("frame")
    t = metres(tracking.where("visible"))
    step = F.when(F.lead("frame").over(track) == F.col("frame") + 1, F.sqrt(F.pow(F.lead("x").over(track) - F.col("x"), 2) + F.pow(F.lead("y").over(track) - F.col("y"), 2)))
    return t.withColumn("_d", step).withColumn("speed", F.when(F.col("_d") >= 0.04, F.least(F.col("_d") * fps, F.lit(9.45)))).drop("_d")


def noise_lab(tracking: DataFrame, drop_percent: float, sigma: float, seed: int = 7) -> DataFrame:
    """Drops bround(n * percent / 100) players of each frame and moves the others by up to sigma metres, within the pitch."""
    row = (*FRAME, "team", "player_id")
    frame = Window.partitionBy(*FRAME)
    t = metres(tracking.where("visible")).withColumns({"_r": F.row_number().over(frame.orderBy(uniform(seed, "drop", *row), "team", "player_id")), "_n": F.count("*").over(frame)})
    t = t.where(F.col("_r") > F.bround(F.col("_n") * drop_percent / 100.0, 0)).drop("_r", "_n")
    move = lambda c, size: clip(F.col(c) + (2.0 * uniform(seed, f"move_{c}", *row) - 1.0) * sigma, 0, size)
    return t.withColumns({"x": move("x", LENGTH), "y": move("y", WIDTH)})


def display_noise(tracking: DataFrame, drop_percent: float, sigma: float) -> DataFrame:
    """noise_lab with the draws of a display: FNV-1a of frame, player and purpose; half a player rounds up."""
    draw = lambda use: fnv_unit(F.concat_ws(":", F.col("frame").cast("string"), F.col("player_id"), F.lit(use)))
    frame = Window.partitionBy(*FRAME)
    t = metres(tracking.where("visible")).withColumns({"_r": F.row_number().over(frame.orderBy(draw("drop"), "team", "player_id")), "_n": F.count("*").over(frame)})
    t = t.where(F.col("_r") > F.floor(F.col("_n") * drop_percent / 100.0 + 0.5)).drop("_r", "_n")
    return t.withColumns({c: clip(F.col(c) + (2.0 * draw(c) - 1.0) * sigma, 0, size) for c, size in (("x", LENGTH), ("y", WIDTH))})


def four_point_homography(image: list[tuple[float, float]], pitch: list[tuple[float, float]]) -> np.ndarray:
    """The 3 x 3 matrix that takes four image points to four pitch points."""
    rows, right = [], []
    for (u, v), (x, y) in zip(image, pitch, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def project(u: Column, v: Column, h: np.ndarray, margin: float | None = None) -> tuple[Column, Column, Column]:
    """x, y and whether they are on the pitch (within margin, if given); null where the point has no image."""
    a = [[float(x) for x in row] for row in h]
    line = lambda r: a[r][0] * u + a[r][1] * v + a[r][2]
    w = line(2)
    fine = F.abs(w) >= 1e-7
    x, y = F.when(fine, line(0) / w), F.when(fine, line(1) / w)
    m = 0.0 if margin is None else margin
    return x, y, F.coalesce(x.between(-m, 1 + m) & y.between(-m, 1 + m), F.lit(False))


def moving_blend(values: Column, order: WindowSpec, share: float) -> Column:
    """Exponential mean along a window's order: share of each new value, the rest of the mean so far; the first as it is.

    What lies so far back that its weight is under 2**-60 has no part, so a row reads a bounded
    number of rows before it however long its track is.
    """
    depth = math.ceil(60 * math.log(2) / -math.log(1.0 - share))
    last = F.collect_list(values).over(order.rowsBetween(-depth, 0))
    return F.aggregate(F.slice(last, 2, depth), F.get(last, F.lit(0)), lambda mean, v: (1.0 - share) * mean + share * v)


def foot_points(boxes: DataFrame, track: list[str], share: float = 0.5) -> DataFrame:
    """Adds u, v: the middle of each box's lower edge, smoothed along its track's frames."""
    order = Window.partitionBy(*track).orderBy("frame")
    return boxes.withColumns({"u": moving_blend((F.col("x1") + F.col("x2")) / 2.0, order, share), "v": moving_blend(F.col("y2").cast("double"), order, share)})


def blended_matrices(observed: DataFrame, keys: list[str], share: float = 0.25) -> DataFrame:
    """Homographies (h: nine numbers, by row, the last not 0) blended with those of earlier frames, each scaled to a last number of 1."""
    order = Window.partitionBy(*keys).orderBy("frame")
    one = lambda i: F.get("h", F.lit(i)) / F.get("h", F.lit(8))
    return observed.withColumn("h", F.array(*[moving_blend(one(i), order, share) for i in range(8)], F.lit(1.0)))


def drift_shift(seen: Column, expected: Column | float) -> Column:
    """How far a landmark's drift moves a frame along the pitch: .18 of an error over .005, at most .025."""
    error = F.lit(expected) - seen if isinstance(expected, float) else expected - seen
    return F.when(F.abs(error) > 0.005, clip(0.18 * error, -0.025, 0.025)).otherwise(0.0)


def polygon_distance(u: Column, v: Column, polygon: list[tuple[float, float]]) -> Column:
    """Distance to the outline of a polygon, positive within and negative outside."""
    edges = list(zip(polygon, polygon[1:] + polygon[:1], strict=True))

    def reach(a: tuple[float, float], b: tuple[float, float]) -> Column:
        dx, dy = b[0] - a[0], b[1] - a[1]
        at = clip(((u - a[0]) * dx + (v - a[1]) * dy) / ((dx * dx + dy * dy) or 1.0), 0, 1)
        return F.hypot(u - a[0] - at * dx, v - a[1] - at * dy)

    crossed = [F.when((v < a[1]) != (v < b[1]), (u < (v - a[1]) * ((b[0] - a[0]) / ((b[1] - a[1]) or 1.0)) + a[0]).cast("int")).otherwise(0) for a, b in edges]
    return F.least(*[reach(a, b) for a, b in edges]) * F.when(sum(crossed, F.lit(0)) % 2 == 1, 1.0).otherwise(-1.0)


def inside_lines(u: Column, v: Column, top: float = 0.0, bottom: float = 9999.0, polygon: list[tuple[float, float]] | None = None) -> Column:
    """Whether an image point is between the touchlines (4 pixels above, 6 below) and at most 4 outside the turf's polygon."""
    fine = v.between(top - 4.0, bottom + 6.0)
    return fine if polygon is None else fine & (polygon_distance(u, v, polygon) >= -4.0)


def on_pitch_only(points: DataFrame, x: str = "x", y: str = "y", margin: float = 0.015, edge: float = 0.005) -> DataFrame:
    """Points within margin of the pitch, clipped to edge within it."""
    kept = points.where(F.col(x).between(-margin, 1 + margin) & F.col(y).between(-margin, 1 + margin))
    return kept.withColumns({c: clip(F.col(c), edge, 1 - edge) for c in (x, y)})


def suppress_duplicates(boxes: DataFrame, frame: list[str], smallest: tuple[float, float] | None = None, largest: float | None = None) -> DataFrame:
    """Boxes (x1, y1, x2, y2) of a frame, the tallest first, without those that lie over one that was kept.

    A box lies over another if they share over .60 of the narrower one's width and over .65 of its
    own height. smallest: least width and height, largest: most height of a box that counts. Boxes
    of one height go from left to right. A frame's boxes are one array, folded in the JVM.
    """
    wide, tall = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    if smallest:
        boxes = boxes.where((wide >= smallest[0]) & (tall >= smallest[1]))
    if largest is not None:
        boxes = boxes.where(tall <= largest)
    rest = [c for c in boxes.columns if c not in (*frame, "x1", "y1", "x2", "y2")]
    box = F.struct((-tall).alias("order"), "x1", "y1", "x2", "y2", *([F.struct(*rest).alias("rest")] if rest else []))
    shared = lambda a, b, lo, hi: F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])
    over = lambda b, k: (shared(b, k, "x1", "x2") > 0.60 * F.least(b["x2"] - b["x1"], k["x2"] - k["x1"])) & (shared(b, k, "y1", "y2") > 0.65 * (b["y2"] - b["y1"]))
    own = boxes.groupBy(*frame).agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: over(b, k)), kept).otherwise(F.concat(kept, F.array(b))))
    out = own.select(*frame, F.explode(kept).alias("b"))
    return out.select(*frame, *[F.col(f"b.{c}") for c in ("x1", "y1", "x2", "y2")], *([F.col(f"b.rest.{c}") for c in rest])).select(*boxes.columns)


def stitch_tracklets(tracklets: DataFrame, before: int = 15, after: int = 120, speed: float = 7.5, slack: float = 3.5, fps: int = 25) -> DataFrame:
    """Adds stitched_id: tracklets (match_id, team, player_id, first/last frame and position) chained in order of their start.

    A tracklet takes over the nearest chain of its team that ended from before frames later to after
    frames earlier and within slack metres and speed metres a second, of equally near ones (9 decimals)
    the first by name. A chain ends where the latest of its tracklets does. A chain that ended longer
    ago can take over nothing more, so a team's tracklets are cut where all before ended so long ago,
    and the parts are dealt to tasks.
    """
    order = Window.partitionBy("match_id", "team").orderBy("first_frame", "last_frame", "player_id")
    reached = F.max("last_frame").over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = tracklets.withColumn("_cut", F.coalesce((F.col("first_frame") - reached > after).cast("int"), F.lit(1)))
    t = t.withColumn("_part", F.sum("_cut").over(order)).drop("_cut")
    names = ["first_frame", "last_frame", "player_id", "first_x", "first_y", "last_x", "last_y"]

    def chain(group: pa.Table) -> pa.Table:
        rows = sorted(zip(range(group.num_rows), *(group.column(c).to_pylist() for c in names), strict=True), key=lambda r: r[1:4])
        ids: list = [None] * len(rows)
        tails: dict[str, tuple] = {}
        for at, first, last, name, x, y, end_x, end_y in rows:
            tails = {k: v for k, v in tails.items() if first - v[0] <= after}
            near = [(round(math.hypot((x - v[1]) * LENGTH, (y - v[2]) * WIDTH), 9), k) for k, v in tails.items() if first - v[0] >= -before]
            near = [(d, k) for d, k in near if d <= slack + speed * max(first - tails[k][0], 0) / fps]
            ids[at] = own = min(near)[1] if near else name
            if own not in tails or tails[own][0] <= last:
                tails[own] = (last, end_x, end_y)
        return group.drop_columns(["_part"]).append_column("stitched_id", pa.array(ids, pa.string()))

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in tracklets.schema.fields)}, stitched_id string"
    return t.groupBy("match_id", "team", "_part").applyInArrow(chain, schema)


def densify(tracking: DataFrame, first: int, last: int) -> DataFrame:
    """Each track on every frame of a span, gaps filled linearly and ends with the nearest known point."""
    tracks = tracking.select(*TRACK).distinct()
    spine = tracks.withColumn("frame", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("frame", F.col("frame").cast("long"))
    t = spine.join(tracking.where("visible").select(*TRACK, "frame", "x", "y"), [*TRACK, "frame"], "left")
    order = Window.partitionBy(*TRACK).orderBy("frame")
    seen = F.when(F.col("x").isNotNull(), F.struct("frame", "x", "y"))
    t = t.withColumns({"a": F.last(seen, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(seen, True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    at = F.when(F.col("b.frame") > F.col("a.frame"), (F.col("frame") - F.col("a.frame")) / (F.col("b.frame") - F.col("a.frame"))).otherwise(0.0)
    fill = lambda c: F.coalesce(F.col(f"a.{c}") + at * (F.col(f"b.{c}") - F.col(f"a.{c}")), F.col(f"a.{c}"), F.col(f"b.{c}"), F.lit(0.5))
    return t.select(*TRACK, "frame", clip(fill("x"), 0, 1).alias("x"), clip(fill("y"), 0, 1).alias("y"), F.col("x").isNull().alias("imputed"))
