"""Queries on the adapter tables: lookups, state vectors, the ranking grid, image geometry, kits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions.hashing import uniform
from trackloom.functions.scalars import run_fields
from trackloom.operators import degrade, kits, lookup, matching, passes, pitch, quality, serve, stats
from trackloom.oracles.core import CTES, advantage, clip, define, sql, u
from trackloom.queries_core import GEOMETRY, rounded, rounds
from trackloom.queries_passes import _candidates, _ranked, H, STATE, actual_targets, candidates, holders, runs, static_candidates, CONDITIONS
from trackloom.queries_passes import ORACLE_SQL as PASS_SQL
from trackloom.sources.adapter import reference_events, tracking

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return add


# -- lookups --------------------------------------------------------------------------------------

define("sides", "SELECT match_id, frame, count(DISTINCT team) FILTER (visible) > 1 AS both_sides FROM tracking GROUP BY ALL")
define(
    "frame_best",
    """SELECT f.match_id, f.frame, CASE WHEN fine THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN fine THEN upper(team) || '_' || player_id END AS possessor_id, CASE WHEN fine THEN player_id END AS player_id,
CASE WHEN fine THEN team END AS team, CASE WHEN fine THEN round(raw_score, 6) END AS score FROM (SELECT s.*, b.team, b.player_id, b.raw_score, both_sides AND b.player_id IS NOT NULL AS fine FROM sides s LEFT JOIN static_best b ON b.match_id = s.match_id AND b.frame = s.frame) f""",
)
define("near_pairs", CTES["features"].split("LEFT JOIN (", 1)[1].rsplit(")", 1)[0])
define(
    "held_features",
    """SELECT t.match_id, t.frame, t.player_id AS possessor_id, t.team AS possessor_team, g.* EXCLUDE (match_id, frame), pressure AS possessor_pressure, coalesce(support, 0) AS possessor_support, coalesce(forward, 0) AS forward_options
FROM static_best t LEFT JOIN geometry g ON t.match_id = g.match_id AND t.frame = g.frame LEFT JOIN near_pairs p ON p.match_id = t.match_id AND p.frame = t.frame AND p.src_team = t.team AND p.src_id = t.player_id""",
)


@query("catalogue", "SELECT match_id, replace(match_id, '_', ' ') AS label, 25 AS fps, count(DISTINCT frame) AS frame_count, true AS tracking_available, match_id IN (SELECT match_id FROM annotated) AS events_available FROM tracking GROUP BY match_id")
def _(spark, d):
    return lookup.catalogue(tracking(spark, d), reference_events(spark, d))


@query("tracking_defaults", f"SELECT match_id, frame, {rounds('timestamp')}, player_id, team, x, y, 1.0::DOUBLE AS confidence, true AS visible FROM tracking")
def _(spark, d):
    """Rows whose confidence and visibility were left out where they say nothing."""
    bare = tracking(spark, d).withColumns({"confidence": F.nullif(F.col("confidence"), F.lit(0.0)), "visible": F.nullif(F.col("visible"), F.lit(False))})
    return rounded(lookup.with_defaults(bare), "timestamp")


@query("frame_possession", "SELECT * FROM frame_best")
def _(spark, d):
    return rounded(lookup.frame_possession(tracking(spark, d)), "score")


@query("possession_at", "SELECT * FROM frame_best WHERE match_id = '3' AND frame = (SELECT frame FROM tracking WHERE match_id = '3' AND frame BETWEEN 1 AND 1e9 ORDER BY abs(frame - (SELECT max(frame) + 7 FROM tracking WHERE match_id = '3')), frame LIMIT 1)")
def _(spark, d):
    """Seven frames beyond the match's last one, which is the nearest."""
    t = tracking(spark, d)
    last = t.where("match_id = '3'").agg(F.max("frame")).first()[0] or 0
    return rounded(lookup.possession_at(t, "3", last + 7), "score")


@query(
    "frame_tactics",
    f"""SELECT b.*, round(tas, 6) AS tas, possessor_support, {rounds('possessor_pressure', *GEOMETRY)} FROM frame_best b
LEFT JOIN geometry g ON g.match_id = b.match_id AND g.frame = b.frame
LEFT JOIN (SELECT match_id, frame, possessor_support, possessor_pressure, {advantage(None)} AS tas FROM held_features) s ON s.match_id = b.match_id AND s.frame = b.frame AND b.status = 'available'""",
)
def _(spark, d):
    return rounded(lookup.frame_tactics(tracking(spark, d)), "score", "tas", "possessor_pressure", *GEOMETRY)


@query(
    "possession_range",
    "SELECT b.* EXCLUDE (status) FROM frame_best b JOIN (SELECT frame, row_number() OVER (ORDER BY frame) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT frame FROM tracking WHERE match_id = '3' AND frame BETWEEN 5 AND 90)) s ON s.frame = b.frame WHERE match_id = '3' AND status = 'available' AND ((r - 1) % 7 = 0 OR r = n)",
)
def _(spark, d):
    return rounded(lookup.possession_range(tracking(spark, d), "3", 5, 90, 7), "score")


ORACLE_SQL["event_metrics_at"] = f"SELECT * FROM ({PASS_SQL['event_prf']}) WHERE tolerance = 0.5::DOUBLE"


@query("event_metrics_at")
def _(spark, d):
    out = lookup.metrics_at(matching.precision_recall(static_candidates(tracking(spark, d)), reference_events(spark, d), (0.2, 0.5)), 0.5)
    return rounded(out, "precision", "recall", "f1", "mean_error_seconds")


@query(
    "clip_summary",
    f""", f AS (SELECT match_id, possessor_team AS team, {advantage('forward_options')} AS tas FROM held_features WHERE (match_id, frame) IN (SELECT (match_id, frame) FROM tracking GROUP BY match_id, frame HAVING count(*) >= 4))
SELECT match_id, coalesce(h, 0) AS home_share, coalesce(a, 0) AS away_share, coalesce(t, 0.5) AS mean_tas, coalesce(n, 0) AS frames FROM (SELECT DISTINCT match_id FROM tracking) LEFT JOIN (
SELECT match_id, round(100.0::DOUBLE * count(*) FILTER (team = 'home') / count(*), 1) AS h, round(100.0::DOUBLE * count(*) FILTER (team = 'away') / count(*), 1) AS a, round(avg(tas), 4) AS t, count(*) AS n FROM f GROUP BY match_id) USING (match_id)""",
)
def _(spark, d):
    return lookup.clip_summary(tracking(spark, d))


VECTOR = ("pressure_index", "nearest_opponent", "team_width", "team_length", "compactness", "team_spread", "confidence")


@query(
    "state_vector",
    f"""SELECT match_id, frame, team, player_id, support_count, local_density, NULL::BIGINT AS forward_options, {rounds(*VECTOR)} FROM (
SELECT v.match_id, v.frame, v.team, v.player_id, coalesce(support_count, 0) AS support_count, coalesce(local_density, 0) AS local_density, coalesce(pressure_index, 0) AS pressure_index, nearest_opponent, team_width, team_length, 1 / (1 + team_spread / 12) AS compactness, team_spread, v.trust AS confidence
FROM (SELECT *, avg(confidence) OVER (PARTITION BY match_id, frame) AS trust FROM vis) v LEFT JOIN (
SELECT match_id, frame, team, player_id, count(*) FILTER (same_team AND dist <= 12) AS support_count, count(*) FILTER (dist <= 10) AS local_density, min(dist) FILTER (NOT same_team) AS nearest_opponent,
least(1, coalesce(sum(exp(-dist / 6)) FILTER (NOT same_team), 0) / 2.4::DOUBLE) AS pressure_index FROM mpairs GROUP BY ALL) n USING (match_id, frame, team, player_id) JOIN (
SELECT match_id, frame, team, max(y) - min(y) AS team_width, max(x) - min(x) AS team_length, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS team_spread
FROM (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM m WINDOW w AS (PARTITION BY match_id, frame, team)) GROUP BY ALL) g USING (match_id, frame, team))""",
)
def _(spark, d):
    return rounded(lookup.state_vector(tracking(spark, d)), *VECTOR)


# -- statistics -----------------------------------------------------------------------------------


@query(
    "recovery_by_severity",
    """SELECT severity, count(*) AS n_runs, round(avg(CASE WHEN abs(c - w) > 1e-12 THEN (b - w) / (c - w) END), 6) AS recovery_fraction
FROM (SELECT *, CASE CAST(match_id AS INTEGER) % 3 WHEN 0 THEN 'mild' WHEN 1 THEN 'moderate' ELSE 'severe' END AS severity FROM wide) GROUP BY severity""",
)
def _(spark, d):
    """Matches as runs, each under an id that names its severity."""
    name = F.concat(F.lit("0_60s_seed"), "match_id", F.lit("_"), F.element_at(F.array(*map(F.lit, ("mild", "moderate", "severe"))), F.col("match_id").cast("int") % 3 + 1))
    r = runs(spark, d).withColumn("run_id", name)
    meta = tracking(spark, d).select("match_id").distinct().select(name.alias("run_id"))
    meta = meta.withColumns(run_fields(F.col("run_id")))
    return rounded(stats.recovery_by(stats.recovery_rows(r, ["run_id"], "v", *CONDITIONS), meta, ["run_id"], ["severity"]), "recovery_fraction")


@query(
    "anomaly_context",
    """SELECT a.match_id, a.team, a.player_id, a.frame, round(c.step, 6) AS step, count(*) AS n_anomalies FROM vis a LEFT JOIN steps_of c USING (match_id, team, player_id, frame) JOIN steps_of b
ON a.match_id = b.match_id AND a.team = b.team AND a.player_id = b.player_id AND b.frame BETWEEN a.frame - 10 AND a.frame + 10 AND b.step > 0.6 GROUP BY ALL""",
)
def _(spark, d):
    out = stats.around_anomalies(quality.with_steps(tracking(spark, d)), ["match_id", "team", "player_id"], 0.6)
    return rounded(out, "step").select("match_id", "team", "player_id", "frame", "step", "n_anomalies")


# -- rankings -------------------------------------------------------------------------------------

REPORT = ("mrr", "top1", "top3", "mean_rank")
METHODS = ["decision", "most_forward", "nearest", "tas_baseline", "unranked"]


@query(
    "ranking_report",
    f"""SELECT method, count(rank) AS n_states, {', '.join(f'round(coalesce(avg({e}), 0), 6) AS {n}' for n, e in zip(REPORT, ('1.0::DOUBLE / rank', 'CAST(rank <= 1 AS INTEGER)', 'CAST(rank <= 3 AS INTEGER)', 'rank'), strict=True))}
FROM (SELECT unnest({METHODS}) AS method) LEFT JOIN (SELECT method, rank FROM (SELECT {STATE}, target_player_id, rank, method FROM baselines UNION ALL SELECT {STATE}, target_player_id, rank, 'decision' FROM ranking) JOIN targets USING ({STATE}, target_player_id)) USING (method) GROUP BY method""",
)
def _(spark, d):
    t = tracking(spark, d)
    own = passes.ranked_by(passes.score_passes(candidates(t)), passes.baseline_values() | {"decision": F.col("decision_score")})
    return rounded(passes.ranking_report(own, actual_targets(t), METHODS), *REPORT)


PERTURBATIONS, LEVELS, SEED = ["jitter", "dropout", "availability"], ["mild", "severe"], 72
_ROW = ("match_id", "team", "player_id", "frame")


def _cell(p: str, s: str) -> str:
    scale, share = {"mild": (0.001, 0.02), "moderate": (0.003, 0.08), "severe": (0.008, 0.20)}[s]
    draw = lambda c: clip(f"{c} + sqrt(-2.0::DOUBLE * ln(1 - {u(SEED, f'snap_{c}_u', *_ROW)})) * cos(2 * pi() * {u(SEED, f'snap_{c}_v', *_ROW)}) * {scale}::DOUBLE", 0, 1)
    moved = "" if p == "dropout" else f", {draw('x')} AS x, {draw('y')} AS y"
    kept = "" if p == "jitter" else f" QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY {u(SEED, 'drop', *_ROW)}, {', '.join(_ROW)}) > round_even(count(*) OVER (PARTITION BY match_id, frame) * {share if p == 'dropout' else share / 2}::DOUBLE, 0)"
    return f"SELECT v.* REPLACE (v.match_id || '|{p}|{s}' AS match_id{moved}) FROM (SELECT * FROM vis{kept}) v"


_cells = [(p, s) for p in PERTURBATIONS for s in LEVELS]
define("grid_vis", " UNION ALL ".join(_cell(p, s) for p, s in _cells))
define("grid_best", " UNION ALL ".join(f"SELECT * REPLACE (match_id || '|{p}|{s}' AS match_id) FROM static_best" for p, s in _cells))
_candidates("grid", "grid_vis", "grid_best")
define("grid_decision", _ranked("grid_rows"))
define("grid_base", CTES["baselines"].replace("cand_rows", "grid_rows"))
define("grid_all", f"SELECT {STATE}, target_player_id, rank, method, NULL::DOUBLE AS score FROM grid_base UNION ALL SELECT {STATE}, target_player_id, rank, 'decision', decision_score FROM grid_decision")
define("clean_all", f"SELECT match_id || '|' || cell AS match_id, frame, team, source_player_id, target_player_id, rank, method FROM (SELECT {STATE}, target_player_id, rank, method FROM baselines UNION ALL SELECT {STATE}, target_player_id, rank, 'decision' FROM ranking), (SELECT unnest({[f'{p}|{s}' for p, s in _cells]}) AS cell)")
GRID = ("top1_retention", "top_k_retention", "spearman", "kendall", "displacement", "score_variance", "flip_rate", "changed_rate")
_mean = lambda c: f"coalesce(avg({c}) FILTER (n_common > 0), 0)"


@query(
    "ranking_grid",
    f""", b AS (SELECT {STATE}, method, target_player_id AS t, a.rank AS ra, g.rank AS rb, g.score FROM clean_all a FULL JOIN grid_all g USING ({STATE}, method, target_player_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY {STATE}, method ORDER BY ra) AS ca, row_number() OVER (PARTITION BY {STATE}, method ORDER BY rb) AS cb FROM b WHERE ra IS NOT NULL AND rb IS NOT NULL),
k AS (SELECT {STATE}, method, avg(sign((c.ra - d.ra) * (c.rb - d.rb))) AS kendall FROM c JOIN c d USING ({STATE}, method) WHERE c.t < d.t GROUP BY ALL),
r AS (SELECT {STATE}, method, count(*) AS n_common, CASE WHEN count(*) > 1 THEN corr(ca, cb) ELSE 1 END AS spearman, avg(abs(ra - rb)) AS displacement FROM c GROUP BY ALL),
s AS (SELECT {STATE}, method, max(CASE WHEN ra = 1 THEN t END) IS DISTINCT FROM max(CASE WHEN rb = 1 THEN t END) AS flip, count(*) FILTER (ra <= 3 AND rb <= 3) > 0 AS kept, var_pop(score) FILTER (ra IS NOT NULL) AS score_variance FROM b GROUP BY ALL),
z AS (SELECT s.*, coalesce(n_common, 0) AS n_common, spearman, displacement, CASE WHEN n_common IS NOT NULL THEN coalesce(kendall, 1) END AS kendall FROM s LEFT JOIN r USING ({STATE}, method) LEFT JOIN k USING ({STATE}, method)),
o AS (SELECT method, split_part(match_id, '|', 2) AS perturbation, split_part(match_id, '|', 3) AS severity, count(*) AS n_states, count(*) FILTER (n_common > 0) AS n_valid, {_mean('CAST(NOT flip AS INTEGER)')} AS top1_retention, {_mean('CAST(kept AS INTEGER)')} AS top_k_retention,
{', '.join(f'{_mean(n)} AS {n}' for n in GRID[2:6])}, avg(CAST(flip AS INTEGER)) AS flip_rate, 1 - avg(CAST(kept AS INTEGER)) AS changed_rate FROM z GROUP BY ALL)
SELECT method, perturbation, severity, n_states, n_valid, {rounds(*GRID)} FROM o""",
)
def _(spark, d):
    t = tracking(spark, d)
    return rounded(passes.ranking_grid(t, holders(t), PERTURBATIONS, LEVELS, SEED), *GRID)


# -- image geometry -------------------------------------------------------------------------------

define("feet", "SELECT match_id, team, player_id, frame, (x * 1280 - 12 + x * 1280 + 12) / 2 AS fu, y * 720 AS fv, row_number() OVER (PARTITION BY match_id, team, player_id ORDER BY frame) AS k FROM vis")
define(
    "smooth_feet",
    "SELECT match_id, team, player_id, frame, sum(fu * w) AS u, sum(fv * w) AS v FROM (SELECT a.match_id, a.team, a.player_id, a.frame, b.fu, b.fv, CASE WHEN b.k = 1 THEN pow(0.5::DOUBLE, a.k - 1) ELSE pow(0.5::DOUBLE, a.k - b.k + 1) END AS w FROM feet a JOIN feet b ON a.match_id = b.match_id AND a.team = b.team AND a.player_id = b.player_id AND b.k <= a.k) GROUP BY ALL",
)
TURF = [(60.0, 40.0), (1200.0, 30.0), (1260.0, 700.0), (20.0, 690.0)]


def boxes(spark, d):
    """Visible rows as boxes of a 1280 by 720 image."""
    x, y = F.col("x") * 1280, F.col("y") * 720
    return tracking(spark, d).where("visible").select("match_id", "team", "player_id", "frame", (x - 12).alias("x1"), (y - 60).alias("y1"), (x + 12).alias("x2"), y.alias("y2"))


@query("foot_points", "SELECT match_id, team, player_id, frame, round(u / sqrt(2156800), 6) AS u, round(v / sqrt(2156800), 6) AS v FROM smooth_feet")
def _(spark, d):
    """In shares of the image's diagonal."""
    out = pitch.foot_points(boxes(spark, d), ["match_id", "team", "player_id"])
    return rounded(out.withColumns({c: F.col(c) / F.sqrt(F.lit(2156800.0)) for c in ("u", "v")}), "u", "v").drop("x1", "y1", "x2", "y2")


def _outline() -> str:
    """SQL of the signed distance to TURF: edges as rows, so it shares nothing with the chain of columns."""
    rows = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(TURF, TURF[1:] + TURF[:1], strict=True))
    return f"""SELECT match_id, team, player_id, frame, u, v, min(sqrt(pow(u - ax - g * (bx - ax), 2) + pow(v - ay - g * (by_ - ay), 2))) * CASE WHEN count(*) FILTER (((v < ay) <> (v < by_)) AND u < (v - ay) * (bx - ax) / (by_ - ay) + ax) % 2 = 1 THEN 1 ELSE -1 END AS inside
FROM (SELECT f.*, e.*, least(greatest(((u - ax) * (bx - ax) + (v - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)), 0), 1) AS g FROM smooth_feet f, (VALUES {rows}) e(ax, ay, bx, by_)) GROUP BY ALL"""


@query(
    "on_pitch_points",
    f""", o AS ({_outline()}), h AS (SELECT *, u / 1280 AS pu, v / 720 AS pv FROM o WHERE v BETWEEN 50 - 4 AND 680 + 6 AND inside >= -4),
p AS (SELECT *, ({float(H[0, 0])!r}::DOUBLE * pu + {float(H[0, 1])!r}::DOUBLE * pv + {float(H[0, 2])!r}::DOUBLE) / w AS x, ({float(H[1, 0])!r}::DOUBLE * pu + {float(H[1, 1])!r}::DOUBLE * pv + {float(H[1, 2])!r}::DOUBLE) / w AS y FROM (SELECT *, {float(H[2, 0])!r}::DOUBLE * pu + {float(H[2, 1])!r}::DOUBLE * pv + {float(H[2, 2])!r}::DOUBLE AS w FROM h))
SELECT match_id, team, player_id, frame, round({clip('x', 0.005, 0.995)}, 6) AS x, round({clip('y', 0.005, 0.995)}, 6) AS y FROM p WHERE x BETWEEN -0.015 AND 1.015 AND y BETWEEN -0.015 AND 1.015""",
)
def _(spark, d):
    feet = pitch.foot_points(boxes(spark, d), ["match_id", "team", "player_id"])
    feet = feet.where(pitch.inside_lines(F.col("u"), F.col("v"), 50.0, 680.0, TURF))
    x, y, _ = pitch.project(F.col("u") / 1280, F.col("v") / 720, H)
    out = pitch.on_pitch_only(feet.select("match_id", "team", "player_id", "frame", x.alias("x"), y.alias("y")))
    return rounded(out, "x", "y")


define("seen_h", "SELECT match_id, frame, fi AS k, {h}::DOUBLE[] AS h FROM frames".replace("{h}", "[" + ", ".join(f"({float(v)!r}::DOUBLE + 0.001::DOUBLE * (frame % {7 + i}))" if i < 8 else "1.0" for i, v in enumerate(H.ravel())) + "]"))


@query(
    "blended_homography",
    "SELECT match_id, frame, i, round(sum(v * w), 6) AS value FROM (SELECT a.match_id, a.frame, s.i, b.h[s.i + 1] AS v, CASE WHEN b.k = 1 THEN pow(0.75::DOUBLE, a.k - 1) ELSE 0.25::DOUBLE * pow(0.75::DOUBLE, a.k - b.k) END AS w FROM seen_h a JOIN seen_h b ON a.match_id = b.match_id AND b.k <= a.k, (SELECT unnest(range(9)) AS i) s) GROUP BY ALL",
)
def _(spark, d):
    """A homography seen in each frame, a little off from the last one, as it is blended."""
    h = F.array(*[(F.lit(float(v)) + (0.001 * (F.col("frame") % (7 + i)) if i < 8 else 0.0)) * 2.0 for i, v in enumerate(H.ravel())])
    seen = tracking(spark, d).select("match_id", "frame").distinct().withColumn("h", h)
    out = pitch.blended_matrices(seen, ["match_id"]).select("match_id", "frame", F.posexplode("h").alias("i", "value"))
    return rounded(out.withColumn("i", F.col("i").cast("long")), "value")


# -- kits -----------------------------------------------------------------------------------------


@query(
    "team_kits",
    """SELECT t.match_id, player_id, team = first_team AS with_first, false AS is_referee FROM (SELECT DISTINCT match_id, player_id, team FROM vis) t
JOIN (SELECT match_id, first(team ORDER BY player_id) AS first_team, count(DISTINCT team) AS n FROM vis GROUP BY match_id) f USING (match_id) WHERE n = 2""",
)
def _(spark, d):
    """Shirts in red and blue with noise; matches with both sides."""
    t = tracking(spark, d).where("visible")
    both = t.groupBy("match_id").agg(F.count_distinct("team").alias("n")).where("n = 2").drop("n")
    shade = lambda c, home, away: (F.when(F.col("team") == "home", home).otherwise(away) + 40.0 * (uniform(7, c, "match_id", "player_id", "frame") - 0.5)).alias(c)
    samples = t.join(both, "match_id", "left_semi").select("match_id", "player_id", shade("r", 200, 30), shade("g", 40, 60), shade("b", 40, 200))
    return kits.fit_sides(samples).select("match_id", "player_id", (F.col("cluster") == 0).alias("with_first"), "is_referee")


# -- degradation ----------------------------------------------------------------------------------


@query("frame_map_digest", "SELECT match_id, frame, count(*) AS n, string_agg(concat_ws(':', team, player_id, coalesce(CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR), '-'), coalesce(CAST(CAST(round(y * 1000) AS BIGINT) AS VARCHAR), '-'), CAST(visible AS VARCHAR)), ' ' ORDER BY team, player_id) AS players FROM tracking GROUP BY ALL")
def _(spark, d):
    whole = lambda c: F.coalesce(F.round(c * 1000).cast("long").cast("string"), F.lit("-"))
    text = F.transform("players", lambda p: F.concat_ws(":", p["team"], p["player_id"], whole(p["x"]), whole(p["y"]), p["visible"].cast("string")))
    return serve.frame_map(tracking(spark, d)).select("match_id", "frame", F.size("players").cast("long").alias("n"), F.array_join(text, " ").alias("players"))
