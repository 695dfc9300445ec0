"""The spatial graph of each frame: pairs, nearest neighbours, density, k nearest edges.

A frame has a few dozen players, so they fit an array, in which nearest neighbours and density are
found; no group grows with the data. Where pairs themselves are wanted, they are exploded from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import distance
from trackloom.schema import FRAME, tracking_only


def visible(tracking: DataFrame) -> DataFrame:
    return tracking.where("visible")


def frame_players(tracking: DataFrame) -> DataFrame:
    """A row per frame: timestamp (the least), players (its visible players in order of team and id, an array).

    What is between players of a frame is computed inside the array: one shuffle by frame, no pairs of rows.
    """
    player = F.when(F.col("visible"), F.struct("team", "player_id", "x", "y", "timestamp"))
    return tracking.groupBy(*FRAME).agg(F.min("timestamp").alias("timestamp"), F.sort_array(F.collect_list(player)).alias("players"))


def frame_pairs(tracking: DataFrame) -> DataFrame:
    """All ordered pairs of different visible players in a frame, with distance and same_team.

    A frame's array is exploded twice where it lies: one shuffle, by frame, by which the pairs stay dealt.
    Rows without match or frame pair with none.
    """
    frames = frame_players(tracking.where("match_id IS NOT NULL AND frame IS NOT NULL")).select(*FRAME, "players", F.explode("players").alias("a"))
    pairs = frames.select(*FRAME, F.col("a.team").alias("src_team"), F.col("a.player_id").alias("src_id"), F.col("a.x").alias("sx"), F.col("a.y").alias("sy"), F.explode("players").alias("b"))
    pairs = pairs.select(*FRAME, "src_team", "src_id", "sx", "sy", F.col("b.team").alias("dst_team"), F.col("b.player_id").alias("dst_id"), F.col("b.x").alias("dx"), F.col("b.y").alias("dy")).where("src_team <> dst_team OR src_id <> dst_id")
    return pairs.withColumn("dist", distance(F.col("sx"), F.col("sy"), F.col("dx"), F.col("dy"))).withColumn("same_team", F.col("src_team") == F.col("dst_team"))


def field(*path: str) -> Callable[[Column], Column]:
    """Takes a field of a struct."""

    def of(p: Column) -> Column:
        for name in path:
            p = p[name]
        return p

    return of


def team_is(team: Column | str) -> Callable[[Column], Column]:
    return lambda p: p["team"] == team


def apart(p: Column, q: Column) -> Column:
    return distance(p["x"], p["y"], q["x"], q["y"])


def others(p: Column, same_team: bool, players: Column | str = "players") -> Column:
    """The players of p's frame, p itself left out, that are or aren't in p's team."""
    return F.filter(players, lambda q: (q["team"] == p["team"]) & (q["player_id"] != p["player_id"]) if same_team else q["team"] != p["team"])


#: What is computed of a frame's player.
PLAYER = ("team", "player_id", "x", "y", "timestamp")
#: Pairs that a task holds at once.
PAIRS = 500_000
NODES = "match_id string, frame long, timestamp double, team string, player_id string, x double, y double, nearest_teammate_id string, nearest_teammate_dist double, nearest_opponent_id string, nearest_opponent_dist double, local_density long"


def codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values, -1 for null."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def runs_of(batch: pa.RecordBatch, names: Iterable[str]) -> np.ndarray:
    """Starts of the runs of rows that are equal in some columns."""
    new = np.arange(batch.num_rows) == 0
    for c in names:
        own = codes(batch.column(c))
        new[1:] |= own[1:] != own[:-1]
    return np.flatnonzero(new)


def whole(batches: Iterator[pa.RecordBatch], names: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by some columns, cut so that equal ones stay together."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        last = int(runs_of(batch, names)[-1])
        held = batch.slice(last)
        if last:
            yield batch.slice(0, last)
    if held is not None:
        yield held


def by_frame(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work over batches of whole frames, in order of team and id: one shuffle and one sort, that spills; a task holds a batch and a frame at a time.

    Frames aren't collected into arrays: such an aggregation sorts the rows on both sides of the shuffle.
    """
    key = [*FRAME, "team", "player_id"]
    return rows.repartition(*FRAME).sortWithinPartitions(*key, *[c for c in rows.columns if c not in key]).mapInArrow(lambda batches: work(whole(batches, FRAME)), schema)


class Players:
    """A batch of frames' players as arrays: frame i has those from at[i] on, size[i] of them; a null coordinate is NaN, a null name has code -1."""

    def __init__(self, batch: pa.RecordBatch):
        self.at = runs_of(batch, FRAME)
        self.size = np.diff(self.at, append=batch.num_rows)
        self.frame = np.repeat(np.arange(len(self.at)), self.size)
        self.column = {c: batch.column(c) for c in batch.schema.names}
        self.x, self.y = (self.column[c].to_numpy(zero_copy_only=False) for c in ("x", "y"))
        self.team, self.id = (codes(self.column[c]) for c in ("team", "player_id"))

    def beside(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Players some (by place), in parts, with every player of their frames: the part's places in some, starts of its runs of pairs, pairs' other ends."""
        n = self.size[self.frame[some]]
        ends = np.cumsum(n)
        low = 0
        while low < len(some):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - n[low] + PAIRS, "right")))
            start = ends[low:high] - n[low:high] - (ends[low] - n[low])
            other = np.arange(int(n[low:high].sum())) - np.repeat(start - self.at[self.frame[some[low:high]]], n[low:high])
            yield np.arange(low, high), start, other
            low = high

    def sides(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether q is another player of p's team, and whether it is of another team; a null team is of neither."""
        known = (self.team[p] >= 0) & (self.team[q] >= 0)
        same = self.team[p] == self.team[q]
        return known & same & (self.id[p] != self.id[q]) & (self.id[p] >= 0) & (self.id[q] >= 0), known & ~same

    def apart(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        dx, dy = self.x[p] - self.x[q], self.y[p] - self.y[q]
        return np.sqrt(dx * dx + dy * dy)


def least(values: np.ndarray, some: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per run of values the least of some of them, infinite if there is none; NaN doesn't count."""
    return np.minimum.reduceat(np.where(some & ~np.isnan(values), values, np.inf), start)


def first_of(hits: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per run the place of its first hit, -1 if there is none."""
    at = np.where(hits, np.arange(len(hits)), len(hits))
    at = np.minimum.reduceat(at, start)
    return np.where(at < len(hits), at, -1)


def graph_nodes(tracking: DataFrame, density_radius: float = 0.05) -> DataFrame:
    """Visible players with nearest teammate and opponent (id, distance; null if none) and local density.

    One shuffle, by frame; the pairs of a batch of frames are computed as arrays, PAIRS at a time, and none is sorted or leaves its task.
    """

    def nearest(t: Players, one: np.ndarray, dist: np.ndarray, some: np.ndarray, start: np.ndarray, other: np.ndarray) -> tuple[pa.Array, pa.Array]:
        best = least(dist, some, start)
        none = np.isinf(best)
        # a frame's players lie in order of team and id, so the first of equally near ones counts
        own = first_of(some & (np.isnan(dist) | (dist == np.repeat(best, np.diff(start, append=len(dist))))) & (~np.isnan(dist) | np.repeat(none, np.diff(start, append=len(dist)))), start)
        names = t.column["player_id"].take(pa.array(np.where(own < 0, 0, other[own]), mask=own < 0))
        return names, pa.array(best, mask=none)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Players(batch)
            for places, start, other in t.beside(np.arange(len(t.frame))):
                one = np.repeat(places, np.diff(start, append=len(other)))
                dist, (mate, foe) = t.apart(one, other), t.sides(one, other)
                density = np.add.reduceat((mate | foe) & (dist < density_radius), start, dtype=np.int64)
                head = [t.column[c].take(pa.array(places)) for c in (*FRAME, "timestamp", "team", "player_id", "x", "y")]
                yield pa.RecordBatch.from_arrays([*head, *nearest(t, one, dist, mate, start, other), *nearest(t, one, dist, foe, start, other), pa.array(density)], [c.split()[0] for c in NODES.split(", ")])

    return by_frame(visible(tracking).select(*FRAME, *PLAYER), nodes, NODES)


def knn_edges(tracking: DataFrame, k: int = 5) -> DataFrame:
    """Directed edges to the k nearest players, ties by team and id."""
    nearest = Window.partitionBy(*FRAME, "src_team", "src_id").orderBy("dist", "dst_team", "dst_id")
    return frame_pairs(tracking).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select(*FRAME, "src_team", "src_id", "dst_team", "dst_id", "dist", "rank")


def spatial_features(tracking: DataFrame, density_radius: float = 0.05) -> DataFrame:
    return graph_nodes(tracking_only(tracking), density_radius)
