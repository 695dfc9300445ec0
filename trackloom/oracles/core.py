"""SQL building blocks: common table expressions by name, put together as a query needs them."""

from __future__ import annotations

import re

from trackloom.operators.possession import WEIGHTS

CTES: dict[str, str] = {}


def define(name: str, body: str) -> None:
    CTES[name] = body


def sql(body: str) -> str:
    """The body under all expressions that it names, in the order of their definition."""
    need: set[str] = set()
    todo = [body]
    while todo:
        for word in set(re.findall(r"\w+", todo.pop())) & CTES.keys() - need:
            need.add(word)
            todo.append(CTES[word])
    if not need:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in need) + "\n" + body  # a body that begins with a comma adds its own


def define_again(prefix: str, names: list[str], **instead: str) -> None:
    """The named expressions once more as prefix + name, over each other and over what is put instead of a name."""
    to = {n: prefix + n for n in names} | instead
    for n in names:
        define(prefix + n, re.sub(rf"\b(FROM|JOIN) ({'|'.join(to)})\b", lambda m: f"{m[1]} {to[m[2]]}", CTES[n]))


def u(seed: int, tag: str, *keys: str) -> str:
    """The hash uniform of functions.hashing."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{tag}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def clip(v: str, low: float, high: float) -> str:
    return f"(CASE WHEN ({v}) IS NOT NULL THEN least(greatest({v}, CAST({low} AS DOUBLE)), CAST({high} AS DOUBLE)) END)"


define(
    "all_rows",
    """
SELECT CAST(CAST(floor(user_id / 22.0) AS BIGINT) AS VARCHAR) AS match_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
  CAST(user_id AS VARCHAR) AS player_id, CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'away' END AS team, event_type <> 'error' AS visible, value, props, event_type, event_id
FROM events""",
)
define(
    "tracking",
    """
SELECT match_id, frame, frame * CAST(0.04 AS DOUBLE) AS timestamp, player_id, team,
  CASE WHEN visible THEN (CAST(round(value * 100) AS BIGINT) % 1000) / CAST(1000 AS DOUBLE) END AS x,
  CASE WHEN visible THEN CAST(props->>'$.k' AS INTEGER) / CAST(100 AS DOUBLE) END AS y,
  CASE WHEN visible THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence, visible
FROM all_rows""",
)
define(
    "annotated",
    """
SELECT match_id, event_id, frame AS start_frame, CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'signup' THEN 'RECOVERY' ELSE 'BALL LOST' END AS event_type
FROM all_rows WHERE event_type IN ('purchase', 'signup', 'click')""",
)
define("vis", "SELECT * FROM tracking WHERE visible")
define("frames", "SELECT match_id, frame, min(timestamp) AS timestamp, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS fi FROM tracking GROUP BY match_id, frame")
define(
    "pairs",
    """
SELECT a.match_id, a.frame, a.team AS src_team, a.player_id AS src_id, b.team AS dst_team, b.player_id AS dst_id, a.x AS sx, a.y AS sy, b.x AS dx, b.y AS dy,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, a.team = b.team AS same_team
FROM vis a JOIN vis b ON a.match_id = b.match_id AND a.frame = b.frame AND (a.team <> b.team OR a.player_id <> b.player_id)""",
)
define(
    "nodes",
    """
SELECT v.match_id, v.frame, v.timestamp, v.team, v.player_id, v.x, v.y, mate_id AS nearest_teammate_id, mate AS nearest_teammate_dist, foe_id AS nearest_opponent_id, foe AS nearest_opponent_dist, coalesce(density, 0) AS local_density
FROM vis v LEFT JOIN (
  SELECT match_id, frame, src_team, src_id, min(dist) FILTER (same_team) AS mate, first(dst_id ORDER BY dist, dst_team, dst_id) FILTER (same_team) AS mate_id,
    min(dist) FILTER (NOT same_team) AS foe, first(dst_id ORDER BY dist, dst_team, dst_id) FILTER (NOT same_team) AS foe_id, count(*) FILTER (dist < 0.05) AS density
  FROM pairs GROUP BY ALL) p ON v.match_id = p.match_id AND v.frame = p.frame AND v.team = p.src_team AND v.player_id = p.src_id""",
)


def _norm(v: str) -> str:
    low, high = (f"{f}({v}) OVER (PARTITION BY match_id, frame)" for f in ("min", "max"))
    return f"CASE WHEN {high} - {low} < 1e-12 THEN 0 ELSE ({v} - {low}) / ({high} - {low}) END"


def _close(c: str) -> str:
    return f"1.0 / (coalesce({c}, max({c}) OVER (PARTITION BY match_id, frame) + 0.01, 1.0) + CAST(1e-6 AS DOUBLE))"


for _name, _motion in (("dynamic", True), ("static", False)):
    define(
        f"{_name}_raw",
        f"""
SELECT n.*, fi,
  {_close("nearest_opponent_dist")} AS opponent_raw, {_close("nearest_teammate_dist")} AS teammate_raw,
  1.0 / (sqrt(pow(x - 0.5, 2) + pow(y - 0.5, 2)) + CAST(1e-6 AS DOUBLE)) AS centre_raw,
  CASE WHEN count(*) OVER side > 1 THEN 1.0 / (stddev_pop(x) OVER side + stddev_pop(y) OVER side + CAST(1e-6 AS DOUBLE)) ELSE 0 END AS compact_raw,
  lag(fi) OVER track = fi - 1 AS one, lag(fi, 2) OVER track = fi - 2 AS two,
  (x - lag(x) OVER track) / CAST(0.04 AS DOUBLE) AS vx, (y - lag(y) OVER track) / CAST(0.04 AS DOUBLE) AS vy,
  (lag(x) OVER track - lag(x, 2) OVER track) / CAST(0.04 AS DOUBLE) AS ux, (lag(y) OVER track - lag(y, 2) OVER track) / CAST(0.04 AS DOUBLE) AS uy
FROM nodes n JOIN (SELECT match_id, frame, fi FROM frames) USING (match_id, frame)
WINDOW side AS (PARTITION BY match_id, frame, team), track AS (PARTITION BY match_id, team, player_id ORDER BY frame)""",
    )
    define(
        f"{_name}_motion",
        f"""
SELECT *, {"CASE WHEN one THEN 1.0 / (sqrt(pow(vx - CASE WHEN two THEN ux ELSE 0 END, 2) + pow(vy - CASE WHEN two THEN uy ELSE 0 END, 2)) / CAST(0.04 AS DOUBLE) + CAST(1e-6 AS DOUBLE)) ELSE 0 END" if _motion else "CAST(0 AS DOUBLE)"} AS continuity,
  {"CASE WHEN one THEN greatest(CASE WHEN team = 'home' THEN vx ELSE -vx END, 0) ELSE 0 END" if _motion else "CAST(0 AS DOUBLE)"} AS ahead
FROM {_name}_raw""",
    )
    define(
        f"{_name}_features",
        f"""
SELECT match_id, frame, timestamp, fi, team, player_id, {_norm("opponent_raw")} AS opponent_proximity, {_norm("teammate_raw")} AS teammate_proximity,
  {_norm("CAST(local_density AS DOUBLE)")} AS local_density, {_norm("centre_raw")} AS centrality, {_norm("continuity")} AS movement_continuity,
  {_norm("ahead")} AS forward_progress, {_norm("compact_raw")} AS team_compactness
FROM {_name}_motion""",
    )
    define(f"{_name}_scores", f"SELECT *, round({' + '.join(f'{k} * CAST({w} AS DOUBLE)' for k, w in WEIGHTS.items())}, 9) AS raw_score FROM {_name}_features")
define("static_best", "SELECT * FROM static_scores QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY raw_score DESC, team, player_id) = 1")
define(
    "tops",
    """
SELECT f.match_id, f.frame, f.timestamp, f.fi, s.team AS best_team, s.player_id AS best_id, s.raw_score AS top
FROM frames f LEFT JOIN (SELECT * FROM dynamic_scores QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY raw_score DESC, team, player_id) = 1) s ON f.match_id = s.match_id AND f.fi = s.fi""",
)
define(
    "steps",
    """
SELECT match_id, CAST(0 AS BIGINT) AS fi, CAST(NULL AS VARCHAR) AS cur_team, CAST(NULL AS VARCHAR) AS cur_id, CAST(0 AS BIGINT) AS held, CAST(0 AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS confidence
FROM (SELECT DISTINCT match_id FROM frames)
UNION ALL
SELECT match_id, fi, new_team, new_id, CASE WHEN new_id IS NOT DISTINCT FROM cur_id AND new_team IS NOT DISTINCT FROM cur_team THEN held + 1 ELSE 1 END,
  CASE WHEN none THEN 0 WHEN keep THEN now ELSE top END, CASE WHEN none OR top <= 0 THEN 0 ELSE least(1, CASE WHEN keep THEN now ELSE top END / top) END
FROM (
  SELECT *, CASE WHEN none THEN NULL WHEN keep THEN cur_team ELSE best_team END AS new_team, CASE WHEN none THEN NULL WHEN keep THEN cur_id ELSE best_id END AS new_id
  FROM (
    SELECT t.match_id, t.fi, cur_team, cur_id, held, best_team, best_id, top, coalesce(s.raw_score, 0) AS now, coalesce(top < 0.10, true) AS none,
      cur_id IS NOT NULL AND (cur_id <> best_id OR cur_team <> best_team) AND (held < 5 OR top - coalesce(s.raw_score, 0) < 0.15) AS keep
    FROM steps p JOIN tops t ON t.match_id = p.match_id AND t.fi = p.fi + 1
    LEFT JOIN dynamic_scores s ON s.match_id = t.match_id AND s.fi = t.fi AND s.team = p.cur_team AND s.player_id = p.cur_id))""",
)
define("timeline", "SELECT s.match_id, f.frame, f.timestamp, cur_id AS possessor_id, cur_team AS team, score AS possession_score, confidence FROM steps s JOIN frames f ON s.match_id = f.match_id AND s.fi = f.fi")
define(
    "changes",
    """
SELECT *, possessor_id IS DISTINCT FROM from_player_id AND team IS DISTINCT FROM from_team AS turn FROM (
  SELECT *, lag(possessor_id) OVER w AS from_player_id, lag(team) OVER w AS from_team, row_number() OVER w AS n FROM timeline WINDOW w AS (PARTITION BY match_id ORDER BY frame))
WHERE n > 1 AND (possessor_id IS DISTINCT FROM from_player_id OR team IS DISTINCT FROM from_team)""",
)
define(
    "candidates",
    """
SELECT match_id, frame, timestamp, CASE WHEN from_team IS NULL OR team IS NULL THEN 'possession_change' WHEN from_team = team THEN 'pass_candidate' ELSE 'turnover_candidate' END AS event_type,
  from_player_id, possessor_id AS to_player_id, from_team, team AS to_team FROM changes
UNION ALL
SELECT match_id, frame, timestamp, 'recovery_candidate', from_player_id, possessor_id, from_team, team
FROM (SELECT *, lag(from_team) OVER (PARTITION BY match_id ORDER BY frame) AS lost FROM changes WHERE turn) WHERE from_team IS NOT NULL AND lost = team""",
)
define(
    "geometry",
    "SELECT match_id, frame, "
    + ", ".join(
        f"avg(x) FILTER (team = '{t}') AS {t}_centroid_x, avg(y) FILTER (team = '{t}') AS {t}_centroid_y, max(y) FILTER (team = '{t}') - min(y) FILTER (team = '{t}') AS {t}_width, "
        f"max(x) FILTER (team = '{t}') - min(x) FILTER (team = '{t}') AS {t}_length, (max(y) FILTER (team = '{t}') - min(y) FILTER (team = '{t}')) * (max(x) FILTER (team = '{t}') - min(x) FILTER (team = '{t}')) AS {t}_compactness_area"
        for t in ("home", "away")
    )
    + " FROM vis GROUP BY match_id, frame",
)
define(
    "features",
    """
SELECT t.match_id, t.frame, t.possessor_id, t.team AS possessor_team, g.* EXCLUDE (match_id, frame), pressure AS possessor_pressure,
  CASE WHEN t.possessor_id IS NOT NULL THEN coalesce(support, 0) END AS possessor_support, CASE WHEN t.possessor_id IS NOT NULL THEN coalesce(forward, 0) ELSE 0 END AS forward_options
FROM timeline t LEFT JOIN geometry g ON t.match_id = g.match_id AND t.frame = g.frame
LEFT JOIN (
  SELECT match_id, frame, src_team, src_id, min(dist) FILTER (NOT same_team) AS pressure, count(*) FILTER (same_team AND dist > 0 AND dist <= 0.15) AS support,
    count(*) FILTER (same_team AND CASE WHEN src_team = 'home' THEN dx > sx ELSE dx < sx END) AS forward
  FROM pairs GROUP BY ALL) p ON p.match_id = t.match_id AND p.frame = t.frame AND p.src_team = t.team AND p.src_id = t.possessor_id""",
)


def advantage(forward: str | None) -> str:
    area = "CASE WHEN possessor_team = 'home' THEN away_compactness_area ELSE home_compactness_area END"
    base = f"0.35::DOUBLE * {clip('coalesce(possessor_pressure, 0) / 0.3::DOUBLE', 0, 1)} + 0.15::DOUBLE * {clip('coalesce(possessor_support, 0) / 3.0::DOUBLE', 0, 1)} + 0.15::DOUBLE * coalesce({clip(f'({area}) / 0.4::DOUBLE', 0, 1)}, 1)"
    whole = f"({base}) / 0.65::DOUBLE" if forward is None else f"{base} + 0.35::DOUBLE * {clip(f'{forward} / 4.0::DOUBLE', 0, 1)}"
    return f"CASE WHEN possessor_team IS NULL THEN 0 ELSE {clip(whole, 0, 1)} END"


define("tas", f"SELECT match_id, frame, {advantage('forward_options')} AS tas FROM features")
