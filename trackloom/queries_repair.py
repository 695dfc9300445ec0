"""Queries on the adapter tables: repair, noise, quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import degrade, possession, quality, repair, tactics
from trackloom.oracles.core import CTES, define, define_again, sql, u
from trackloom.queries_core import rounded, rounds
from trackloom.schema import COLUMNS, FRAME
from trackloom.sources.adapter import tracking
from trackloom.sources.shared import work_folder

QUERIES = {}
ORACLE_SQL = {}
ROW = ("match_id", "team", "player_id", "frame")
TRACK = "match_id, team, player_id"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return add


# -- repair ---------------------------------------------------------------------------------------


def _interpolated(source: str) -> str:
    return f"""
SELECT match_id, frame, timestamp, player_id, team, CASE WHEN fill THEN ax + (frame - af) / CAST(bf - af AS DOUBLE) * (bx - ax) ELSE x END AS x,
  CASE WHEN fill THEN ay + (frame - af) / CAST(bf - af AS DOUBLE) * (byy - ay) ELSE y END AS y, CASE WHEN fill THEN CAST(0.5 AS DOUBLE) ELSE confidence END AS confidence, visible OR fill AS visible, fill AS imputed
FROM (
  SELECT *, NOT visible AND bf > af AND bp - ap - 1 <= 10 IS TRUE AS fill FROM (
    SELECT *, last_value(CASE WHEN visible THEN frame END IGNORE NULLS) OVER b AS af, last_value(x IGNORE NULLS) OVER b AS ax, last_value(y IGNORE NULLS) OVER b AS ay, last_value(CASE WHEN visible THEN pos END IGNORE NULLS) OVER b AS ap,
      first_value(CASE WHEN visible THEN frame END IGNORE NULLS) OVER a AS bf, first_value(x IGNORE NULLS) OVER a AS bx, first_value(y IGNORE NULLS) OVER a AS byy, first_value(CASE WHEN visible THEN pos END IGNORE NULLS) OVER a AS bp
    FROM (SELECT *, row_number() OVER (PARTITION BY {TRACK} ORDER BY frame) AS pos FROM {source})
    WINDOW b AS (PARTITION BY {TRACK} ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY {TRACK} ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


def _runs(source: str, cuts: tuple[int, ...] = ()) -> str:
    piece = " + ".join(["0", *[f"CASE WHEN frame >= {c} THEN 1 ELSE 0 END" for c in cuts]])
    return f"""
SELECT *, count(*) OVER (PARTITION BY {TRACK}, run, piece) AS n, row_number() OVER (PARTITION BY {TRACK}, run, piece ORDER BY frame) - 1 AS i
FROM (SELECT *, sum(CASE WHEN visible THEN 0 ELSE 1 END) OVER (PARTITION BY {TRACK} ORDER BY frame) AS run, {piece} AS piece FROM {source}) WHERE visible"""


def _smooth(runs: str, source: str, value) -> str:
    return f"""
SELECT t.* EXCLUDE (x, y), coalesce(s.x, t.x) AS x, coalesce(s.y, t.y) AS y FROM {source} t LEFT JOIN (
  SELECT match_id, team, player_id, frame, {value("x")} AS x, {value("y")} AS y FROM {runs} WINDOW w AS (PARTITION BY {TRACK}, run, piece ORDER BY frame)) s USING (match_id, team, player_id, frame)"""


def _ma(c: str, size: int = 5) -> str:
    over = lambda h: f"avg({c}) OVER (PARTITION BY {TRACK}, run, piece ORDER BY frame ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    return f"CASE WHEN n >= 5 THEN {over(2)} WHEN n >= 3 THEN {over(1)} ELSE {c} END"


def _savgol(c: str) -> str:
    def fit(size: int) -> str:
        t = np.arange(size) - size // 2
        a = np.stack([t**0, t, t**2], 1)
        h = a @ np.linalg.solve(a.T @ a, a.T)
        at = lambda row: " + ".join(f"CAST({float(h[row, j])!r} AS DOUBLE) * " + (f"lead({c}, {j - row}) OVER w" if j > row else f"lag({c}, {row - j}) OVER w" if j < row else c) for j in range(size))
        ends = " ".join(f"WHEN i = {e} THEN {at(e)} WHEN n - 1 - i = {e} THEN {at(size - 1 - e)}" for e in range(size // 2))
        return f"CASE {ends} ELSE {at(size // 2)} END"

    return f"CASE WHEN n >= 7 THEN {fit(7)} WHEN n >= 5 THEN {fit(5)} ELSE {c} END"


define("interpolated", _interpolated("tracking"))
define("vis_runs", _runs("tracking"))
define("cut_runs", _runs("tracking", (20, 45)))
define("interpolated_runs", _runs("interpolated"))
define("averaged", _smooth("vis_runs", "tracking", _ma))
define("cut_averaged", _smooth("cut_runs", "tracking", _ma))
define("savgol_rows", _smooth("vis_runs", "tracking", _savgol))
define("track_rows", f"SELECT *, row_number() OVER (PARTITION BY {TRACK} ORDER BY frame) AS pos FROM tracking")
define(
    "filter_steps",
    """
SELECT match_id, team, player_id, pos, frame, x AS sx, y AS sy, CAST(0 AS DOUBLE) AS vx, CAST(0 AS DOUBLE) AS vy, CAST(0.01 AS DOUBLE) AS u, visible AS alive, frame AS last FROM track_rows WHERE pos = 1
UNION ALL
SELECT match_id, team, player_id, pos, frame, CASE WHEN NOT visible THEN NULL WHEN fresh THEN x ELSE sx + vx + g * (x - sx - vx) END, CASE WHEN NOT visible THEN NULL WHEN fresh THEN y ELSE sy + vy + g * (y - sy - vy) END,
  CASE WHEN NOT visible OR fresh THEN 0 ELSE vx + g * (x - sx - vx) / 2 END, CASE WHEN NOT visible OR fresh THEN 0 ELSE vy + g * (y - sy - vy) / 2 END,
  CASE WHEN NOT visible OR fresh THEN u ELSE (1 - g) * (u + 0.001::DOUBLE) END, visible, CASE WHEN visible THEN frame ELSE last END
FROM (SELECT r.match_id, r.team, r.player_id, r.pos, r.frame, r.x, r.y, r.visible, f.sx, f.sy, f.vx, f.vy, f.u, f.last, NOT f.alive OR r.frame <> f.last + 1 AS fresh, (f.u + 0.001::DOUBLE) / (f.u + 0.001::DOUBLE + 0.01::DOUBLE) AS g
  FROM filter_steps f JOIN track_rows r ON r.match_id = f.match_id AND r.team = f.team AND r.player_id = f.player_id AND r.pos = f.pos + 1)""",
)
XY = "match_id, frame, team, player_id, visible, round(x, 6) AS x, round(y, 6) AS y"


def xy(df):
    return rounded(df.select("match_id", "frame", "team", "player_id", "visible", "x", "y"), "x", "y")


@query("interpolated", f"SELECT {XY}, imputed, confidence FROM interpolated")
def _(spark, d):
    return rounded(repair.interpolate(tracking(spark, d)), "x", "y").drop("timestamp")


@query("moving_average", f"SELECT {XY} FROM averaged")
def _(spark, d):
    return xy(repair.moving_average(tracking(spark, d)))


@query("cut_aware_ma", f"SELECT {XY} FROM cut_averaged")
def _(spark, d):
    return xy(repair.moving_average(tracking(spark, d), cut_frames=(20, 45)))


@query("savgol", f"SELECT {XY} FROM savgol_rows")
def _(spark, d):
    return xy(repair.savitzky_golay(tracking(spark, d)))


@query("alpha_beta", "SELECT match_id, frame, team, player_id, round(sx, 6) AS x, round(sy, 6) AS y, alive AS visible FROM filter_steps")
def _(spark, d):
    return xy(repair.causal_filter(tracking(spark, d)))


define(
    "gap_rows",
    f"""SELECT {TRACK}, visible, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS length FROM (
SELECT *, sum(fresh) OVER (PARTITION BY {TRACK} ORDER BY frame) AS run FROM (SELECT *, CASE WHEN visible IS DISTINCT FROM lag(visible) OVER (PARTITION BY {TRACK} ORDER BY frame) THEN 1 ELSE 0 END AS fresh FROM tracking)) GROUP BY {TRACK}, visible, run""",
)


@query("gap_runs", "SELECT * FROM gap_rows")
def _(spark, d):
    return repair.gap_runs(tracking(spark, d))


define(
    "cuts",
    """
SELECT match_id, frame, np AS visible_count_previous, nc AS visible_count_current, m AS matched_track_count, gap AS frame_gap, h AS high_motion_fraction, c AS visible_count_change_fraction, mean_displacement,
  h >= 0.5 OR (c >= 0.4 AND h >= 0.25) AS candidate_cut, 0.65::DOUBLE * h + 0.35::DOUBLE * least(c, 1) AS cut_score
FROM (SELECT *, abs(nc - np) / CAST(greatest(np, 1) AS DOUBLE) AS c, CASE WHEN m > 0 THEN jumps / CAST(m AS DOUBLE) ELSE 0 END AS h FROM (
  SELECT f.match_id, f.frame, coalesce(p.n, 0) AS np, coalesce(v.n, 0) AS nc, coalesce(j.m, 0) AS m, coalesce(j.jumps, 0) AS jumps, coalesce(j.d, 0) AS mean_displacement, CASE WHEN q.frame IS NOT NULL THEN 1 END AS gap
  FROM frames f LEFT JOIN frames q ON q.match_id = f.match_id AND q.frame = f.frame - 1
  LEFT JOIN (SELECT match_id, frame, count(*) AS n FROM vis GROUP BY ALL) v ON v.match_id = f.match_id AND v.frame = f.frame
  LEFT JOIN (SELECT match_id, frame, count(*) AS n FROM vis GROUP BY ALL) p ON p.match_id = f.match_id AND p.frame = f.frame - 1
  LEFT JOIN (SELECT match_id, frame, count(*) AS m, count(*) FILTER (step > 0.05) AS jumps, avg(step) AS d FROM steps_of GROUP BY ALL) j ON j.match_id = f.match_id AND j.frame = f.frame))""",
)
define(
    "steps_of",
    "SELECT b.match_id, b.team, b.player_id, b.frame, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS step FROM vis a JOIN vis b ON a.match_id = b.match_id AND a.team = b.team AND a.player_id = b.player_id AND b.frame = a.frame + 1",
)
CTES["cuts"] = CTES.pop("cuts")  # after steps_of


@query("candidate_cuts", f"SELECT * REPLACE ({rounds('high_motion_fraction', 'visible_count_change_fraction', 'mean_displacement', 'cut_score')}) FROM cuts")
def _(spark, d):
    return rounded(repair.candidate_cuts(tracking(spark, d)), "high_motion_fraction", "visible_count_change_fraction", "mean_displacement", "cut_score")


# -- quality --------------------------------------------------------------------------------------

QUALITY = ["missingness", "completeness", "coordinate_validity", "interpolation_fraction", "anomaly_rate"]


def _quality(source: str, imputed: str = "CAST(0 AS DOUBLE)") -> str:
    return f"""
SELECT q.match_id, 1 - avg(CAST(visible AS INTEGER)) AS missingness, sum(CAST(visible AS INTEGER)) / CAST(count(DISTINCT frame) * count(DISTINCT (team, player_id)) AS DOUBLE) AS completeness,
  count(*) FILTER (visible AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) / CAST(sum(CAST(visible AS INTEGER)) AS DOUBLE) AS coordinate_validity, {imputed} AS interpolation_fraction,
  coalesce(any_value(m.adjacent_steps), 0) AS adjacent_steps, coalesce(any_value(m.motion_anomalies), 0) AS motion_anomalies, coalesce(any_value(m.motion_anomalies) / CAST(any_value(m.adjacent_steps) AS DOUBLE), 0) AS anomaly_rate
FROM {source} q LEFT JOIN (
  SELECT b.match_id, count(*) AS adjacent_steps, count(*) FILTER (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) > 0.05) AS motion_anomalies
  FROM {source} a JOIN {source} b ON a.match_id = b.match_id AND a.team = b.team AND a.player_id = b.player_id AND b.frame = a.frame + 1 AND a.visible AND b.visible GROUP BY b.match_id) m ON m.match_id = q.match_id
GROUP BY q.match_id"""


define("quality_rows", _quality("tracking"))


@query("tracking_quality", f"SELECT * REPLACE ({rounds(*QUALITY)}) FROM quality_rows")
def _(spark, d):
    return rounded(quality.tracking_quality(tracking(spark, d)), *QUALITY)


EXTENDED = [*QUALITY, "mean_gap_length", "trajectory_continuity", "mean_displacement", "p95_displacement", "velocity_stability", "acceleration_stability"]


@query(
    "step80_quality",
    f""", s AS (SELECT *, step / 0.04::DOUBLE AS speed FROM steps_of),
a AS (SELECT *, speed - lag(speed) OVER (PARTITION BY {TRACK} ORDER BY frame) AS a FROM s),
j AS (SELECT *, a - lag(a) OVER (PARTITION BY match_id ORDER BY team, player_id, frame) AS j FROM a WHERE a IS NOT NULL),
z AS (SELECT q.*, g.* EXCLUDE (match_id), n / CAST(room AS DOUBLE) AS trajectory_continuity, m.* EXCLUDE (match_id, n), acceleration_stability, candidate_cut_count
FROM quality_rows q LEFT JOIN (SELECT match_id, count(*) AS gap_count, avg(length) AS mean_gap_length, max(length) AS max_gap_length FROM gap_rows WHERE NOT visible GROUP BY match_id) g ON g.match_id = q.match_id
LEFT JOIN (SELECT match_id, count(*) AS n, avg(step) AS mean_displacement, quantile_cont(step, 0.95) AS p95_displacement, stddev_pop(a) AS velocity_stability FROM a GROUP BY match_id) m ON m.match_id = q.match_id
LEFT JOIN (SELECT match_id, stddev_pop(j) AS acceleration_stability FROM j GROUP BY match_id) k ON k.match_id = q.match_id
LEFT JOIN (SELECT match_id, greatest(count(*) - count(DISTINCT frame), 1) AS room FROM tracking GROUP BY match_id) r ON r.match_id = q.match_id
LEFT JOIN (SELECT match_id, count(*) FILTER (candidate_cut) AS candidate_cut_count FROM cuts GROUP BY match_id) c ON c.match_id = q.match_id)
SELECT * REPLACE ({rounds(*EXTENDED)}) FROM z""",
)
def _(spark, d):
    return rounded(quality.extended_quality(tracking(spark, d)), *EXTENDED)


@query(
    "api_tracking_quality",
    f""", f AS (SELECT DISTINCT match_id, frame FROM vis),
s AS (SELECT match_id, CAST(greatest(coalesce(floor(quantile_cont(d, 0.5)), 1), 1) AS BIGINT) AS frame_step, count(*) AS frame_count FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY match_id ORDER BY frame) AS d FROM f) GROUP BY match_id),
r AS (SELECT v.*, frame_step, frame_count, CAST(greatest(round_even((frame - lag(frame) OVER (PARTITION BY {TRACK} ORDER BY frame)) / CAST(frame_step AS DOUBLE), 0) - 1, 0) AS BIGINT) AS gap FROM (SELECT DISTINCT {TRACK}, frame FROM vis) v JOIN s USING (match_id))
SELECT {TRACK}, frame_step, frame_count, count(*) AS observed_frames, round(least(1, count(*) / greatest(round_even((max(frame) - min(frame)) / CAST(any_value(frame_step) AS DOUBLE), 0) + 1, 1)), 4) AS active_frame_coverage,
  count(*) FILTER (gap > 0) AS gap_count, coalesce(max(gap), 0) * any_value(frame_step) AS longest_gap_frames FROM r GROUP BY match_id, team, player_id, frame_step, frame_count""",
)
def _(spark, d):
    return quality.api_quality(tracking(spark, d))


define("jitter_rows", f"SELECT match_id, stddev_samp(v) AS velocity_jitter FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS v FROM tracking WINDOW w AS (PARTITION BY {TRACK} ORDER BY frame)) GROUP BY match_id")


@query("velocity_jitter", "SELECT match_id, round(velocity_jitter, 6) AS velocity_jitter FROM jitter_rows")
def _(spark, d):
    return rounded(quality.velocity_jitter(tracking(spark, d)), "velocity_jitter")


@query(
    "speed_quantiles",
    f"""SELECT match_id, round(avg(s), 6) AS mean_speed, round(quantile_cont(s, 0.5), 6) AS median_speed, round(quantile_cont(s, 0.95), 6) AS p95_speed, round(avg(CAST(visible AS INTEGER)), 6) AS coverage
FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / (timestamp - lag(timestamp) OVER w) * 85 AS s FROM tracking WINDOW w AS (PARTITION BY {TRACK} ORDER BY frame)) GROUP BY match_id""",
)
def _(spark, d):
    return rounded(quality.kinematics(tracking(spark, d)), "mean_speed", "median_speed", "p95_speed", "coverage")


# -- noise ----------------------------------------------------------------------------------------


def _hidden(source: str, rule: str) -> str:
    return f"SELECT * EXCLUDE (hide) REPLACE (CASE WHEN NOT hide THEN x END AS x, CASE WHEN NOT hide THEN y END AS y, CASE WHEN hide THEN CAST(0 AS DOUBLE) ELSE confidence END AS confidence, visible AND NOT hide AS visible) FROM (SELECT *, coalesce({rule}, false) AS hide FROM {source})"


def _gauss(seed: int, tag: str) -> str:
    return f"sqrt(-2.0::DOUBLE * ln(1 - {u(seed, tag + '_u', *ROW)})) * cos(2 * pi() * {u(seed, tag + '_v', *ROW)})"


def _gaps(source: str, seed: int, start: float, p: float, low: int, high: int) -> str:
    length = f"CAST(least(greatest(ceil(ln(1 - {u(seed, 'gap_length', *ROW)}) / ln(CAST({1 - p!r} AS DOUBLE))), {low}), {high}) AS BIGINT)"
    return f"""SELECT * EXCLUDE (pos, reach) FROM ({_hidden(f'''(SELECT *, max(CASE WHEN visible AND {u(seed, "gap_start", *ROW)} < {start} THEN pos + {length} END) OVER (PARTITION BY {TRACK} ORDER BY frame) AS reach
FROM (SELECT *, row_number() OVER (PARTITION BY {TRACK} ORDER BY frame) AS pos FROM {source}))''', 'reach > pos')})"""


def _jitter(source: str, seed: int, scale: float) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CASE WHEN visible THEN {c} + {_gauss(seed, f"jitter_{c}")} * CAST({scale} AS DOUBLE) ELSE {c} END AS {c}' for c in 'xy')}) FROM {source}"


def _jumps(source: str, seed: int, p: float, low: float, high: float) -> str:
    move = lambda f: f"(CAST({low} AS DOUBLE) + {u(seed, 'jump_size', *ROW)} * CAST({high - low!r} AS DOUBLE)) * {f}({u(seed, 'jump_angle', *ROW)} * (2 * pi()))"
    hit = f"visible AND {u(seed, 'jump', *ROW)} < {p}"
    return f"SELECT * REPLACE (CASE WHEN {hit} THEN x + {move('cos')} ELSE x END AS x, CASE WHEN {hit} THEN y + {move('sin')} ELSE y END AS y) FROM {source}"


def _fragments(source: str, seed: int, p: float, splits: int) -> str:
    return f"""SELECT * EXCLUDE (pos, n, h, cut, chosen, part) REPLACE (CASE WHEN chosen THEN player_id || '_frag_' || part ELSE player_id END AS player_id) FROM (
SELECT *, {u(seed, 'frag', 'match_id', 'team', 'player_id')} < {p} AND n > {splits} AS chosen, CAST(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY {TRACK} ORDER BY frame) AS VARCHAR) AS part FROM (
SELECT *, pos > 0 AND row_number() OVER (PARTITION BY {TRACK} ORDER BY h NULLS LAST, frame) <= {splits} AS cut FROM (
SELECT *, CASE WHEN pos > 0 THEN {u(seed, 'frag_cut', *ROW)} END AS h FROM (
SELECT *, row_number() OVER (PARTITION BY {TRACK} ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY {TRACK}) AS n FROM {source}))))"""


define("missing_rows", _hidden("tracking", f"{u(42, 'missing', *ROW)} < 0.05"))
define("gapped_rows", _gaps("tracking", 42, 0.02, 0.2, 2, 8))
define("jitter_xy", _jitter("tracking", 42, 0.003))
define("jumped_rows", _jumps("tracking", 42, 0.05, 0.08, 0.3))
define("fragment_rows", _fragments("tracking", 42, 0.3, 2))


def _switch(prefix: str, source: str, seed: int, p: float, low: int, high: int) -> None:
    """Expressions up to <prefix>switched_rows: labels of a source's teammates changed in order of the pairs."""
    define(
        f"{prefix}switch_pairs",
        f"""SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY frame) - 1 AS i FROM (
SELECT a.match_id, a.team, a.player_id AS p1, b.player_id AS p2, a.frame FROM {source} a JOIN {source} b ON a.match_id = b.match_id AND a.team = b.team AND a.frame = b.frame AND a.player_id < b.player_id
WHERE {u(seed, 'switch', 'a.match_id', 'a.team', 'a.player_id', 'b.player_id')} < {p}) WINDOW w AS (PARTITION BY match_id, team, p1, p2)""",
    )
    define(
        f"{prefix}swaps",
        f"""SELECT match_id, team, frame, p1, p2, row_number() OVER (PARTITION BY match_id, team, frame ORDER BY p1, p2) AS k FROM (
SELECT *, floor({u(seed, 'switch_start', 'match_id', 'team', 'p1', 'p2')} * (n - len + 1)) AS start FROM (SELECT *, least(floor({low} + {u(seed, 'switch_length', 'match_id', 'team', 'p1', 'p2')} * {high - low + 1}), n) AS len FROM {prefix}switch_pairs WHERE n >= {low}))
WHERE i >= start AND i < start + len""",
    )
    define(
        f"{prefix}labels_of",
        f"""SELECT match_id, team, frame, player_id AS own, player_id AS label, CAST(0 AS BIGINT) AS k FROM {source}
UNION ALL SELECT l.match_id, l.team, l.frame, own, CASE label WHEN p1 THEN p2 WHEN p2 THEN p1 ELSE label END, s.k FROM {prefix}labels_of l JOIN {prefix}swaps s ON s.match_id = l.match_id AND s.team = l.team AND s.frame = l.frame AND s.k = l.k + 1""",
    )
    define(f"{prefix}switched_rows", f"SELECT t.* REPLACE (l.label AS player_id) FROM {source} t JOIN (SELECT match_id, team, frame, own, last(label ORDER BY k) AS label FROM {prefix}labels_of GROUP BY ALL) l ON l.match_id = t.match_id AND l.team = t.team AND l.frame = t.frame AND l.own = t.player_id")


_switch("", "tracking", 42, 0.3, 5, 30)


@query("random_missing", f"SELECT {XY} FROM missing_rows")
def _(spark, d):
    return xy(degrade.random_missing(tracking(spark, d), 0.05, 42))


@query("contiguous_gaps", f"SELECT {XY} FROM gapped_rows")
def _(spark, d):
    return xy(degrade.contiguous_gaps(tracking(spark, d), 0.02, 0.2, 2, 8, 42))


@query("coordinate_jitter", f"SELECT {XY} FROM jitter_xy")
def _(spark, d):
    return xy(degrade.coordinate_jitter(tracking(spark, d), 0.003, seed=42))


@query("isolated_jumps", f"SELECT {XY} FROM jumped_rows")
def _(spark, d):
    return xy(degrade.isolated_jumps(tracking(spark, d), 0.05, 0.08, 0.3, 42))


@query("fragmentation", f"SELECT {XY} FROM fragment_rows")
def _(spark, d):
    return xy(degrade.fragmentation(tracking(spark, d), 0.3, 2, 42))


@query("identity_switch", f"SELECT {XY} FROM switched_rows")
def _(spark, d):
    return xy(degrade.identity_switch(tracking(spark, d), 0.3, 5, 30, 42))


# the composition at severity severe, without relabelling, then repair: the three conditions
SEVERE = degrade.SEVERITIES["severe"]
define("d1", _hidden("tracking", f"{u(420, 'missing', *ROW)} < {SEVERE['missing_prob']}"))
define("d2", _gaps("d1", 421, SEVERE["gap_start_prob"], SEVERE["gap_p_continue"], 25, 250))
define("d3", _jitter("d2", 422, SEVERE["jitter_scale"]))
define("degraded", _jumps("d3", 423, SEVERE["jump_prob"], 0.12, 0.5))
define("mended", _interpolated("degraded"))
define("mended_runs", _runs("mended"))
define("mitigated", _smooth("mended_runs", "mended", _ma))
OBSERVED = degrade.NAMES[:4]


def conditions(spark, d):
    """CLEAN, SYNTHETIC-DEGRADED and NOISE-MITIGATED tracking."""
    clean = tracking(spark, d)
    worse = degrade.degrade(clean, "severe", 42, OBSERVED).select(*COLUMNS)
    return {"CLEAN": clean, "SYNTHETIC-DEGRADED": worse, "NOISE-MITIGATED": repair.mitigate(worse, "interpolation_moving_average").select(*COLUMNS)}


define("q_degraded", _quality("degraded"))
define("q_mitigated", _quality("mitigated"))


@query("three_conditions_quality", f"SELECT * REPLACE ({rounds(*QUALITY)}) FROM (SELECT 'CLEAN' AS condition, * FROM quality_rows UNION ALL SELECT 'SYNTHETIC-DEGRADED', * FROM q_degraded UNION ALL SELECT 'NOISE-MITIGATED', * FROM q_mitigated)")
def _(spark, d):
    parts = [quality.tracking_quality(t).select(F.lit(c).alias("condition"), "*") for c, t in conditions(spark, d).items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), *QUALITY)


@query(
    "coord_errors",
    f""", b AS (SELECT t.match_id, t.visible, sqrt(pow(m.x - t.x, 2) + pow(m.y - t.y, 2)) AS e, m.x, m.y FROM tracking t JOIN mitigated m USING (match_id, frame, team, player_id)),
j AS (SELECT match_id, stddev_samp(v) AS v FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS v FROM mitigated WINDOW w AS (PARTITION BY {TRACK} ORDER BY frame)) GROUP BY match_id)
SELECT b.match_id, round(100.0::DOUBLE * (1 - count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / CAST(count(*) AS DOUBLE)), 2) AS missing_pct, round(coalesce(sqrt(avg(e * e)), 0), 4) AS coord_rmse, round(coalesce(avg(e), 0), 4) AS coord_mae, round(coalesce(any_value(j.v), 0), 4) AS velocity_jitter
FROM b LEFT JOIN j ON j.match_id = b.match_id GROUP BY b.match_id""",
)
def _(spark, d):
    c = conditions(spark, d)
    return quality.coordinate_errors(c["CLEAN"], c["NOISE-MITIGATED"])


define("worse_runs", _runs("degraded"))
define("worse_averaged", _smooth("worse_runs", "degraded", _ma))
define("worse_savgol", _smooth("worse_runs", "degraded", _savgol))
define("mended_savgol", _smooth("mended_runs", "mended", _savgol))
define_again("worse_", ["track_rows", "filter_steps"], tracking="degraded")
define_again("mended_", ["track_rows", "filter_steps"], tracking="mended")
REPAIRED = dict(none="degraded", interpolation="mended", moving_average="worse_averaged", savgol="worse_savgol", kalman="worse_filter_steps", interpolation_moving_average="mitigated", interpolation_savgol="mended_savgol", interpolation_kalman="mended_filter_steps")


@query(
    "mitigation_methods",
    ", r AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, match_id, frame, team, player_id, {'sx AS x, sy AS y' if t.endswith('steps') else 'x, y'} FROM {t}" for m, t in REPAIRED.items()) + f"""),
b AS (SELECT method, r.match_id, r.x, r.y, sqrt(pow(r.x - t.x, 2) + pow(r.y - t.y, 2)) AS e FROM tracking t JOIN r USING (match_id, frame, team, player_id)),
j AS (SELECT method, match_id, stddev_samp(v) AS v FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS v FROM r WINDOW w AS (PARTITION BY method, {TRACK} ORDER BY frame)) GROUP BY method, match_id)
SELECT b.method, b.match_id, round(100.0::DOUBLE * (1 - count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / CAST(count(*) AS DOUBLE)), 2) AS missing_pct, round(coalesce(sqrt(avg(e * e)), 0), 4) AS coord_rmse, round(coalesce(avg(e), 0), 4) AS coord_mae, round(coalesce(any_value(j.v), 0), 4) AS velocity_jitter
FROM b LEFT JOIN j ON j.match_id = b.match_id AND j.method = b.method GROUP BY b.method, b.match_id""",
)
def _(spark, d):
    """Every way of repair on the same degraded rows, measured in one pass against the clean rows, which no way multiplies."""
    # noise is drawn once and each way's rows are stored: else one plan holds the noise as often as ways and measures multiply
    folder = work_folder(spark, "repaired")
    degrade.degrade(tracking(spark, d), "severe", 42, OBSERVED).select(*COLUMNS).write.parquet(f"{folder}/degraded")
    worse = spark.read.parquet(f"{folder}/degraded")
    for m in repair.METHODS:
        repair.mitigate(worse, m).select(F.lit(m).alias("method"), *COLUMNS).write.mode("append").parquet(f"{folder}/test")
    return quality.coordinate_errors(tracking(spark, d), spark.read.parquet(f"{folder}/test"), by=("method",))


STATISTICS = ["missing_pct", "perturbation_mean", "perturbation_std", "perturbation_max", "gap_mean", "gap_median", "gap_p95", "gap_p99"]
define("d_frag", _fragments("degraded", 424, SEVERE["frag_prob"], int(SEVERE["frag_num_splits"])).replace("FROM degraded", "FROM (SELECT *, player_id AS orig FROM degraded)"))
_switch("d_", "d_frag", 425, 0.1, 5, 30)


@query("degraded_whole", f"SELECT {XY}, orig AS orig_player_id, confidence FROM d_switched_rows")
def _(spark, d):
    """All six kinds of noise, one upon the other; switches last short enough to happen in short tracks."""
    out = degrade.degrade(tracking(spark, d), "severe", 42, custom=dict(switch_prob=0.1, switch_duration_min=5, switch_duration_max=30))
    return rounded(out.select("match_id", "frame", "team", "player_id", "visible", "x", "y", "orig_player_id", "confidence"), "x", "y")


@query(
    "degradation_stats",
    f""", b AS (SELECT t.match_id, g.visible, sqrt(pow(g.x - t.x, 2) + pow(g.y - t.y, 2)) AS e, g.player_id <> g.orig AS relabelled FROM tracking t JOIN d_frag g ON g.match_id = t.match_id AND g.frame = t.frame AND g.team = t.team AND g.orig = t.player_id),
l AS (SELECT match_id, count(*) AS length FROM (SELECT *, sum(CAST(visible AS INTEGER)) OVER (PARTITION BY {TRACK} ORDER BY frame) AS run FROM d_frag) WHERE NOT visible GROUP BY {TRACK}, run)
SELECT m.*, {rounds('gap_mean', 'gap_median', 'gap_p95', 'gap_p99')}, gap_max FROM (
SELECT match_id, round(100 * (1 - avg(CAST(visible AS INTEGER))), 6) AS missing_pct, round(avg(e), 6) AS perturbation_mean, round(stddev_samp(e), 6) AS perturbation_std, round(max(e), 6) AS perturbation_max, count(*) FILTER (relabelled) AS relabelled_rows FROM b GROUP BY match_id) m
LEFT JOIN (SELECT match_id, avg(length) AS gap_mean, quantile_cont(length, 0.5) AS gap_median, quantile_cont(length, 0.95) AS gap_p95, quantile_cont(length, 0.99) AS gap_p99, max(length) AS gap_max FROM l GROUP BY match_id) g ON g.match_id = m.match_id""",
)
def _(spark, d):
    clean = tracking(spark, d)
    return rounded(quality.degradation_statistics(clean, degrade.degrade(clean, "severe", 42, degrade.NAMES[:5])), *STATISTICS)


CHAIN = ["frames", "vis", "pairs", "nodes", "dynamic_raw", "dynamic_motion", "dynamic_features", "dynamic_scores", "tops", "steps", "timeline", "geometry", "features", "tas"]
define_again("m_", CHAIN, tracking="mitigated")
STABILITY = ["mean_error", "median_error", "correlation", "top_k_agreement", "segment_stability"]


@query(
    "tactical_stability",
    f""", m AS (SELECT *, abs(b - a) AS d, count(*) OVER (PARTITION BY match_id) AS n, row_number() OVER (PARTITION BY match_id ORDER BY a DESC, frame) AS ra, row_number() OVER (PARTITION BY match_id ORDER BY b DESC, frame) AS rb,
  CASE WHEN row_number() OVER w = 1 OR possessor_id IS DISTINCT FROM lag(possessor_id) OVER w THEN 1 ELSE 0 END AS fresh
  FROM (SELECT match_id, frame, round(t.tas, 9) AS a, round(o.tas, 9) AS b, possessor_id FROM tas t JOIN m_tas o USING (match_id, frame) JOIN timeline l USING (match_id, frame)) WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
s AS (SELECT match_id, avg(e) AS segment_stability FROM (SELECT match_id, seg, avg(d) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY match_id ORDER BY frame) AS seg FROM m) WHERE possessor_id IS NOT NULL GROUP BY match_id, seg) GROUP BY match_id)
SELECT * REPLACE ({rounds(*STABILITY)}) FROM (
SELECT m.match_id, count(*) AS n_frames, avg(d) AS mean_error, quantile_cont(d, 0.5) AS median_error, CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN corr(a, b) END AS correlation,
  count(*) FILTER (ra <= 10 AND rb <= 10) / CAST(least(10, count(*)) AS DOUBLE) AS top_k_agreement, any_value(segment_stability) AS segment_stability
FROM m LEFT JOIN s ON s.match_id = m.match_id GROUP BY m.match_id)""",
)
def _(spark, d):
    """Scores on mitigated tracking, with its own possession, against those on clean tracking."""
    c = conditions(spark, d)
    held = {k: possession.predict_possession(c[k]) for k in ("CLEAN", "NOISE-MITIGATED")}
    tas = {k: rounded(tactics.tactical_scores(c[k], held[k]).select(*FRAME, "tas"), "tas", digits=9) for k in held}
    return rounded(quality.tactical_stability(tas["CLEAN"], tas["NOISE-MITIGATED"], held["CLEAN"]), *STABILITY)


@query(
    "static_stability",
    """, a AS (SELECT match_id, frame, player_id AS possessor_id, raw_score AS a FROM static_best),
b AS (SELECT match_id, frame, max(raw_score) AS b FROM dynamic_scores GROUP BY ALL),
m AS (SELECT *, abs(b - a) AS d, count(*) OVER (PARTITION BY match_id) AS n, row_number() OVER (PARTITION BY match_id ORDER BY a DESC, frame) AS ra, row_number() OVER (PARTITION BY match_id ORDER BY b DESC, frame) AS rb,
  CASE WHEN possessor_id IS DISTINCT FROM lag(possessor_id) OVER (PARTITION BY match_id ORDER BY frame) THEN 1 ELSE 0 END AS fresh FROM a JOIN b USING (match_id, frame)),
s AS (SELECT match_id, avg(e) AS segment_stability FROM (SELECT match_id, seg, avg(d) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY match_id ORDER BY frame) AS seg FROM m) GROUP BY match_id, seg) GROUP BY match_id)
SELECT m.match_id, count(*) AS n_frames, round(avg(d), 6) AS mean_error, round(quantile_cont(d, 0.5), 6) AS median_error, round(corr(a, b), 6) AS correlation, round(count(*) FILTER (ra <= 10 AND rb <= 10) / CAST(least(10, count(*)) AS DOUBLE), 6) AS top_k_agreement, round(any_value(segment_stability), 6) AS segment_stability
FROM m JOIN s ON s.match_id = m.match_id GROUP BY m.match_id""",
)
def _(spark, d):
    t = tracking(spark, d)
    clean = possession.memoryless(t)
    a = clean.select("match_id", "frame", F.col("raw_score").alias("tas"))
    b = possession.best_scores(t).select("match_id", "frame", F.col("raw_score").alias("tas"))
    out = quality.tactical_stability(a, b, clean.withColumnRenamed("player_id", "possessor_id"))
    return rounded(out, "mean_error", "median_error", "correlation", "top_k_agreement", "segment_stability")
