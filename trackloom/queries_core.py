"""Queries on the adapter tables: tracking, graph, possession, events, tactics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import graph, possession, tactics, validate
from trackloom.oracles.core import advantage, sql
from trackloom.schema import FRAME
from trackloom.sources.adapter import tracking


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Floating sums differ in the last digits with the order of addition, so both sides round."""
    return df.withColumns({n: F.round(n, digits) for n in names})


def rounds(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


SCORES = ["opponent_proximity", "teammate_proximity", "local_density", "centrality", "movement_continuity", "forward_progress", "team_compactness"]
GEOMETRY = [f"{t}_{m}" for t in ("home", "away") for m in ("centroid_x", "centroid_y", "width", "length", "compactness_area")]

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return add


@query("canonical_tracking", "SELECT * FROM tracking")
def _(spark, d):
    return tracking(spark, d)


@query(
    "validate_tracking",
    """SELECT * FROM (
SELECT 'null_match_id' AS rule, count(*) FILTER (match_id IS NULL) AS violations FROM tracking UNION ALL
SELECT 'duplicate_key', (SELECT count(*) FROM (SELECT 1 FROM tracking GROUP BY match_id, frame, team, player_id HAVING count(*) > 1)) UNION ALL
SELECT 'confidence_range', count(*) FILTER (coalesce(confidence NOT BETWEEN 0 AND 1, true)) FROM tracking UNION ALL
SELECT 'team_vocabulary', count(*) FILTER (coalesce(team NOT IN ('home', 'away', 'referee'), true)) FROM tracking UNION ALL
SELECT 'visible_without_coordinates', count(*) FILTER (visible AND (x IS NULL OR y IS NULL)) FROM tracking UNION ALL
SELECT 'coordinates_without_visible', count(*) FILTER (NOT visible AND (x IS NOT NULL OR y IS NOT NULL)) FROM tracking)""",
)
def _(spark, d):
    return validate.tracking_violations(tracking(spark, d))


@query("frame_pairs", f"SELECT match_id, frame, src_team, src_id, dst_team, dst_id, same_team, {rounds('dist', digits=9)} FROM pairs")
def _(spark, d):
    return rounded(graph.frame_pairs(tracking(spark, d)), "dist", digits=9).drop("sx", "sy", "dx", "dy")


@query("graph_nodes", f"SELECT match_id, frame, team, player_id, x, y, nearest_teammate_id, nearest_opponent_id, local_density, {rounds('nearest_teammate_dist', 'nearest_opponent_dist', 'timestamp')} FROM nodes")
def _(spark, d):
    return rounded(graph.spatial_features(tracking(spark, d)), "nearest_teammate_dist", "nearest_opponent_dist", "timestamp")


@query("knn_edges", f"SELECT match_id, frame, src_team, src_id, dst_team, dst_id, {rounds('dist', digits=9)}, row_number() OVER (PARTITION BY match_id, frame, src_team, src_id ORDER BY dist, dst_team, dst_id) AS rank FROM pairs QUALIFY rank <= 5")
def _(spark, d):
    return rounded(graph.knn_edges(tracking(spark, d)), "dist", digits=9)


@query("possession_scores_static", f"SELECT match_id, frame, team, player_id, raw_score, {rounds(*SCORES)} FROM static_scores")
def _(spark, d):
    return rounded(possession.possession_scores(tracking(spark, d), dynamic=False, index=False), *SCORES).drop("timestamp")


@query("possession_scores_dynamic", f"SELECT match_id, frame, team, player_id, raw_score, {rounds(*SCORES)} FROM dynamic_scores")
def _(spark, d):
    return rounded(possession.possession_scores(tracking(spark, d), index=False), *SCORES).drop("timestamp")


@query("possession_timeline", f"SELECT match_id, frame, possessor_id, team, {rounds('timestamp', 'possession_score', 'confidence')} FROM timeline")
def possession_timeline(spark, d):
    return rounded(possession.predict_possession(tracking(spark, d)), "timestamp", "possession_score", "confidence")


@query("candidate_events", f"SELECT match_id, frame, {rounds('timestamp')}, event_type, from_player_id, to_player_id, from_team, to_team FROM candidates")
def _(spark, d):
    return rounded(possession.infer_events(possession.predict_possession(tracking(spark, d))), "timestamp")


@query(
    "possession_summary",
    """SELECT match_id, count(*) AS total_frames, count(possessor_id) AS possessed_frames, count(*) FILTER (changed) AS switches,
round(100.0::DOUBLE * count(*) FILTER (team = 'home') / count(*), 1) AS home_share, round(100.0::DOUBLE * count(*) FILTER (team = 'away') / count(*), 1) AS away_share, round(avg(confidence), 6) AS mean_confidence
FROM (SELECT *, row_number() OVER w > 1 AND possessor_id IS DISTINCT FROM lag(possessor_id) OVER w AS changed FROM timeline WINDOW w AS (PARTITION BY match_id ORDER BY frame)) GROUP BY match_id""",
)
def _(spark, d):
    return possession.possession_summary(possession.predict_possession(tracking(spark, d)))


@query(
    "video_style_events",
    """, c AS (SELECT *, lag(player_id) OVER w AS a, lag(team) OVER w AS was FROM static_best WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
e AS (SELECT * FROM c WHERE a IS NULL OR a <> player_id OR was <> team)
SELECT match_id, frame, 'PASS' AS event_type, team, a AS from_player_id, player_id AS to_player_id FROM e WHERE was = team UNION ALL
SELECT match_id, frame, 'BALL LOST', was, a, NULL FROM e WHERE was <> team UNION ALL
SELECT match_id, frame, 'RECOVERY', team, NULL, player_id FROM e WHERE was IS NULL OR was <> team""",
)
def _(spark, d):
    return possession.video_events(possession.memoryless(tracking(spark, d)))


@query("tactical_features", f"SELECT match_id, frame, possessor_id, possessor_team, possessor_support, forward_options, {rounds('possessor_pressure', *GEOMETRY)} FROM features")
def _(spark, d):
    t = tracking(spark, d)
    return rounded(tactics.tactical_features(t, possession.predict_possession(t)), "possessor_pressure", *GEOMETRY)


@query("tactical_score", f"SELECT match_id, frame, {rounds('tas')} FROM tas")
def _(spark, d):
    t = tracking(spark, d)
    return rounded(tactics.tactical_scores(t, possession.predict_possession(t)), "tas")


@query("tactical_score_no_direction", f"SELECT match_id, frame, round({advantage(None)}, 6) AS tas FROM features")
def _(spark, d):
    t = tracking(spark, d)
    return rounded(tactics.tactical_scores(t, possession.predict_possession(t), None), "tas")


def flagship(spark, d) -> DataFrame:
    """Who has the ball and how good the position is, frame by frame."""
    t = tracking(spark, d)
    held = possession.predict_possession(t)
    return rounded(tactics.tactical_scores(t, held).join(held, FRAME), "tas", "timestamp", "possession_score", "confidence")


ORACLE_SQL["game_state"] = sql(f"SELECT t.match_id, t.frame, round(tas, 6) AS tas, possessor_id, team, {rounds('timestamp', 'possession_score', 'confidence')} FROM tas t JOIN timeline l ON t.match_id = l.match_id AND t.frame = l.frame")
QUERIES["game_state"] = flagship
