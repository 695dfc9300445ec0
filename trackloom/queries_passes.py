"""Queries on the adapter tables: passes, matching, statistics, serving tables, display measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators import degrade, matching, passes, pitch, possession, quality, serve, stats
from trackloom.oracles.core import clip, define, sql, u
from trackloom.plans import experiment
from trackloom.queries_core import rounded, rounds
from trackloom.queries_repair import conditions
from trackloom.sources.adapter import reference_events, tracking, tracking_from_events

QUERIES = {}
ORACLE_SQL = {}
STATE = "match_id, frame, team, source_player_id"
FEATURES = list(passes.FEATURES)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return add


def holders(t):
    return possession.memoryless(t).select("match_id", "frame", "team", "player_id")


def candidates(t):
    return passes.pass_candidates(t, holders(t))


def actual_targets(t):
    """The possessor's teammate who has the ball in the next frame."""
    order = Window.partitionBy("match_id").orderBy("frame")
    h = holders(t).withColumns({"next": F.lead("player_id").over(order), "next_team": F.lead("team").over(order), "next_frame": F.lead("frame").over(order)})
    h = h.where((F.col("next_frame") == F.col("frame") + 1) & (F.col("next_team") == F.col("team")) & (F.col("next") != F.col("player_id")))
    return h.select("match_id", "frame", "team", F.col("player_id").alias("source_player_id"), F.col("next").alias("target_player_id"))


# -- passes ---------------------------------------------------------------------------------------


def _candidates(name: str, source: str, holders: str = "static_best") -> None:
    """CTEs of the candidates of static possessors from a table of visible rows."""
    define(
        f"{name}_pairs",
        f"""SELECT a.match_id, a.frame, a.team AS src_team, a.player_id AS src_id, b.team AS dst_team, b.player_id AS dst_id, a.x AS sx, a.y AS sy, b.x AS dx, b.y AS dy,
sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, a.team = b.team AS same_team FROM {source} a JOIN {source} b ON a.match_id = b.match_id AND a.frame = b.frame AND (a.team <> b.team OR a.player_id <> b.player_id)""",
    )
    define(
        f"{name}_near",
        f"""SELECT match_id, frame, src_team AS team, src_id AS id, coalesce(min(dist) FILTER (NOT same_team), 1) AS pressure, count(*) FILTER (same_team AND dist > 0 AND dist <= 0.15) AS mates,
coalesce(max(dy) FILTER (same_team) - min(dy) FILTER (same_team), 0) AS width, coalesce(max(dx) FILTER (same_team) - min(dx) FILTER (same_team), 0) AS length FROM {name}_pairs GROUP BY ALL""",
    )
    define(
        f"{name}_moves",
        f"""SELECT p.match_id, p.frame, p.src_team AS team, p.src_id AS s, p.dst_id AS t, p.sx, p.sy, p.dx - p.sx AS lx, p.dy - p.sy AS ly, p.dist FROM {name}_pairs p
JOIN {holders} h ON h.match_id = p.match_id AND h.frame = p.frame AND h.team = p.src_team AND h.player_id = p.src_id WHERE same_team AND dist BETWEEN 0.02 AND 0.70""",
    )
    define(
        f"{name}_blocks",
        f"""SELECT match_id, frame, team, s, t, count(*) FILTER (sqrt(pow(ox - sx - a * lx, 2) + pow(oy - sy - a * ly, 2)) <= 0.035 AND a > 0.05 AND a < 0.95) AS obstruction FROM (
SELECT m.*, f.dx AS ox, f.dy AS oy, least(greatest(((f.dx - m.sx) * lx + (f.dy - m.sy) * ly) / CASE WHEN lx * lx + ly * ly = 0 THEN 1 ELSE lx * lx + ly * ly END, 0), 1) AS a
FROM {name}_moves m JOIN {name}_pairs f ON f.match_id = m.match_id AND f.frame = m.frame AND f.src_team = m.team AND f.src_id = m.s AND NOT f.same_team) GROUP BY ALL""",
    )
    define(
        f"{name}_rows",
        f"""SELECT m.match_id, m.frame, m.team, m.s AS source_player_id, m.t AS target_player_id, m.dist AS distance, way * lx AS forward_progress, atan2(ly, way * lx) AS angle, a.pressure AS source_pressure, b.pressure AS target_pressure,
b.pressure AS target_space, b.mates - CASE WHEN m.dist > 0 AND m.dist <= 0.15 THEN 1 ELSE 0 END AS target_support, coalesce(o.obstruction, 0) AS obstruction, a.width AS team_width, a.length AS team_length
FROM (SELECT *, CASE WHEN team = 'home' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS way FROM {name}_moves) m JOIN {name}_near a ON a.match_id = m.match_id AND a.frame = m.frame AND a.team = m.team AND a.id = m.s
JOIN {name}_near b ON b.match_id = m.match_id AND b.frame = m.frame AND b.team = m.team AND b.id = m.t
LEFT JOIN {name}_blocks o ON o.match_id = m.match_id AND o.frame = m.frame AND o.team = m.team AND o.s = m.s AND o.t = m.t""",
    )


def _ranked(source: str, w: dict | None = None) -> str:
    w = passes.WEIGHTS | (w or {})
    logit = f"1.0::DOUBLE - {clip('distance / 0.7::DOUBLE', 0, 1)} + 0.35::DOUBLE * {clip('forward_progress', -0.3, 0.3)} + 0.3::DOUBLE * {clip('target_pressure / 0.3::DOUBLE', 0, 1)} + 0.2::DOUBLE * {clip('target_space / 0.3::DOUBLE', 0, 1)} + 0.08::DOUBLE * {clip('target_support / 4.0::DOUBLE', 0, 1)} - 0.2::DOUBLE * {clip('obstruction / 3.0::DOUBLE', 0, 1)} - 0.05::DOUBLE * abs(angle) / pi()"
    value = f"{w['space']}::DOUBLE * {clip('target_space / 0.3::DOUBLE', 0, 1)} + {w['support']}::DOUBLE * {clip('target_support / 4.0::DOUBLE', 0, 1)} - {w['pressure']}::DOUBLE * {clip('1.0::DOUBLE - target_pressure / 0.3::DOUBLE', 0, 1)} - {w['distance']}::DOUBLE * {clip('distance / 0.7::DOUBLE', 0, 1)} + {w['forward']}::DOUBLE * {clip('forward_progress / 0.35::DOUBLE', -1, 1)}"
    return f"""SELECT *, row_number() OVER (PARTITION BY {STATE} ORDER BY decision_score DESC, target_player_id) AS rank, count(*) OVER (PARTITION BY {STATE}) AS n_candidates FROM (
SELECT *, round({w['probability']}::DOUBLE * pass_completion_probability + tactical_value, 9) AS decision_score FROM (SELECT *, 1 / (1 + exp(-({clip(f'{logit} - 0.65::DOUBLE', -30, 30)}))) AS pass_completion_probability, {value} AS tactical_value FROM {source}))"""


_candidates("cand", "vis")
define("ranking", _ranked("cand_rows"))
for _name, _w in passes.PROFILES.items():
    define(f"ranking_{_name}", _ranked("cand_rows", _w))
define(
    "targets",
    "SELECT match_id, frame, team, player_id AS source_player_id, nxt AS target_player_id FROM (SELECT *, lead(player_id) OVER w AS nxt, lead(team) OVER w AS nt, lead(frame) OVER w AS nf FROM static_best WINDOW w AS (PARTITION BY match_id ORDER BY frame)) WHERE nf = frame + 1 AND nt = team AND nxt <> player_id",
)
define(
    "baselines",
    " UNION ALL ".join(
        f"SELECT *, row_number() OVER (PARTITION BY {STATE} ORDER BY {o}, target_player_id) AS rank, count(*) OVER (PARTITION BY {STATE}) AS n_candidates, '{m}' AS method FROM cand_rows"
        for m, o in (("nearest", "distance"), ("most_forward", "forward_progress DESC"), ("tas_baseline", "target_space - target_pressure + forward_progress DESC"))
    ),
)
EVAL = ["mrr", "ndcg", "top1", "top3", "mean_rank", "mean_percentile"]


def _eval(source: str, *by: str) -> str:
    head = "".join(f"{b}, " for b in by)
    tail = f" GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {head}count(*) AS n_states, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(1.0::DOUBLE / log2(rank + 1)), 6) AS ndcg, round(avg(CAST(rank <= 1 AS INTEGER)), 6) AS top1, round(avg(CAST(rank <= 3 AS INTEGER)), 6) AS top3,
round(avg(rank), 6) AS mean_rank, round(avg(1 - (rank - 1) / CAST(n_candidates AS DOUBLE)), 6) AS mean_percentile FROM {source} JOIN targets USING ({STATE}, target_player_id){tail}"""


@query("pass_candidates", f"SELECT {STATE}, target_player_id, target_support, obstruction, {rounds(*[f for f in FEATURES if f not in ('target_support', 'obstruction')])} FROM cand_rows")
def _(spark, d):
    return rounded(candidates(tracking(spark, d)), *[f for f in FEATURES if f not in ("target_support", "obstruction")])


@query("pass_probability", f"SELECT {STATE}, target_player_id, {rounds('pass_completion_probability')} FROM ranking")
def _(spark, d):
    out = candidates(tracking(spark, d)).withColumn("pass_completion_probability", passes.pass_probability())
    return rounded(out, "pass_completion_probability").select(*STATE.split(", "), "target_player_id", "pass_completion_probability")


@query("pass_ranking", f"SELECT {STATE}, target_player_id, rank, n_candidates, {rounds('tactical_value', 'decision_score')} FROM ranking")
def _(spark, d):
    out = passes.rank_passes(candidates(tracking(spark, d)))
    return rounded(out, "tactical_value", "decision_score").select(*STATE.split(", "), "target_player_id", "rank", "n_candidates", "tactical_value", "decision_score")


@query("ranking_baselines", _eval("baselines", "method"))
def _(spark, d):
    t = tracking(spark, d)
    return rounded(passes.evaluate_rankings(passes.baseline_rankings(candidates(t)), actual_targets(t), ["method"]), *EVAL)


@query("ranking_eval", _eval("ranking"))
def _(spark, d):
    t = tracking(spark, d)
    return rounded(passes.evaluate_rankings(passes.rank_passes(candidates(t)), actual_targets(t)), *EVAL)


@query("weight_sensitivity", " UNION ALL ".join(f"SELECT '{p}' AS profile, * FROM ({_eval(f'ranking_{p}')})" for p in passes.PROFILES))
def _(spark, d):
    t = tracking(spark, d)
    return rounded(passes.weight_sensitivity(candidates(t), actual_targets(t)), *EVAL)


_ROW = ("match_id", "team", "player_id", "frame")
_shift = lambda c: clip(f"{c} + sqrt(-2.0::DOUBLE * ln(1 - {u(72, f'snap_{c}_u', *_ROW)})) * cos(2 * pi() * {u(72, f'snap_{c}_v', *_ROW)}) * 0.008::DOUBLE", 0, 1)
define("moved", f"SELECT * REPLACE ({_shift('x')} AS x, {_shift('y')} AS y) FROM vis")
_candidates("moved", "moved")
define("moved_ranking", _ranked("moved_rows"))


@query(
    "ranking_stability",
    f""", b AS (SELECT coalesce(a.match_id, b.match_id) AS match_id, coalesce(a.frame, b.frame) AS frame, coalesce(a.team, b.team) AS team, coalesce(a.source_player_id, b.source_player_id) AS source_player_id, coalesce(a.target_player_id, b.target_player_id) AS t, a.rank AS ra, b.rank AS rb, b.decision_score AS score
FROM ranking a FULL JOIN moved_ranking b ON a.match_id = b.match_id AND a.frame = b.frame AND a.team = b.team AND a.source_player_id = b.source_player_id AND a.target_player_id = b.target_player_id),
c AS (SELECT *, row_number() OVER (PARTITION BY {STATE} ORDER BY ra) AS ca, row_number() OVER (PARTITION BY {STATE} ORDER BY rb) AS cb FROM b WHERE ra IS NOT NULL AND rb IS NOT NULL),
k AS (SELECT {STATE}, avg(sign((c.ra - d.ra) * (c.rb - d.rb))) AS kendall FROM c JOIN c d USING ({STATE}) WHERE c.t < d.t GROUP BY ALL),
r AS (SELECT {STATE}, count(*) AS n_common, CASE WHEN count(*) > 1 THEN corr(ca, cb) ELSE 1 END AS spearman, avg(abs(ra - rb)) AS displacement FROM c GROUP BY ALL),
s AS (SELECT {STATE}, max(CASE WHEN ra = 1 THEN t END) IS DISTINCT FROM max(CASE WHEN rb = 1 THEN t END) AS top1_flip, count(*) FILTER (ra <= 3 AND rb <= 3) > 0 AS top_k_retained, var_pop(score) FILTER (ra IS NOT NULL) AS score_variance FROM b GROUP BY ALL)
SELECT {STATE}, top1_flip, top_k_retained, round(score_variance, 6) AS score_variance, coalesce(n_common, 0) AS n_common, round(spearman, 6) AS spearman, round(displacement, 6) AS displacement, round(CASE WHEN n_common IS NOT NULL THEN coalesce(kendall, 1) END, 6) AS kendall
FROM s LEFT JOIN r USING ({STATE}) LEFT JOIN k USING ({STATE})""",
)
def _(spark, d):
    t = tracking(spark, d)
    held = holders(t)
    moved = degrade.perturb_snapshot(t.where("visible"), "jitter", "severe", 72)
    a, b = (passes.rank_passes(passes.pass_candidates(x, held)) for x in (t, moved))
    return rounded(passes.compare_rankings(a, b), "score_variance", "spearman", "displacement", "kendall")


def _fit(steps: int = 500, rate: float = 0.08, penalty: float = 0.05) -> str:
    """The gradient steps of a logistic fit as a recursion, a row a step."""
    each = lambda form: ", ".join(form.format(f) for f in FEATURES)
    logit = " + ".join(f"w_{f} * z_{f}" for f in FEATURES)
    none = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
    step = "w_{0} - %r::DOUBLE * (avg(z_{0} * (p - y)) + %r::DOUBLE * w_{0})" % (rate, penalty)
    last = f"(SELECT * FROM fitted WHERE k = {steps}), spreads"
    return f""", labelled AS MATERIALIZED (SELECT {each("CAST(c.{0} AS DOUBLE) AS {0}")}, CASE WHEN t.match_id IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS y FROM cand_rows c LEFT JOIN targets t
  ON t.match_id = c.match_id AND t.frame = c.frame AND t.team = c.team AND t.source_player_id = c.source_player_id AND t.target_player_id = c.target_player_id WHERE {none}),
spreads AS MATERIALIZED (SELECT {each("avg({0}) AS m_{0}, CASE WHEN stddev_pop({0}) < 1e-9 THEN 1::DOUBLE ELSE stddev_pop({0}) END AS s_{0}")} FROM labelled),
standard AS MATERIALIZED (SELECT y, {each("({0} - m_{0}) / s_{0} AS z_{0}")} FROM labelled, spreads),
fitted AS (SELECT 0 AS k, 0::DOUBLE AS b, {each("0::DOUBLE AS w_{0}")}
UNION ALL
SELECT k + 1, b - {rate!r}::DOUBLE * avg(p - y), {each(step)}
FROM (SELECT *, 1 / (1 + exp(-greatest(-30::DOUBLE, least(30::DOUBLE, b + {logit})))) AS p FROM fitted, standard WHERE k < {steps}) GROUP BY k, b, {each("w_{0}")})
SELECT '' AS feature, round(b - ({" + ".join(f"w_{f} / s_{f} * m_{f}" for f in FEATURES)}), 6) AS weight FROM {last}
""" + "\n".join(f"UNION ALL SELECT '{f}', round(w_{f} / s_{f}, 6) FROM {last}" for f in FEATURES)


@query("fit_logistic", _fit())
def _(spark, d):
    """The coefficients of a fit on whether the ranked target got the ball."""
    t = tracking(spark, d)
    rows = candidates(t).join(actual_targets(t).withColumn("hit", F.lit(1)), [*STATE.split(", "), "target_player_id"], "left").fillna(0, ["hit"])
    w = passes.fit_pass_weights(rows, "hit")
    return spark.createDataFrame([(n, round(x, 6)) for n, x in w.items()], "feature string, weight double")


# -- matching -------------------------------------------------------------------------------------

_kind = "CASE event_type WHEN 'PASS' THEN 'pass_candidate' WHEN 'BALL LOST' THEN 'turnover_candidate' WHEN 'RECOVERY' THEN 'recovery_candidate' END"
define(
    "video_kinds",
    """SELECT match_id, frame, CASE WHEN was IS NULL THEN 'recovery_candidate' WHEN was = team THEN 'pass_candidate' ELSE 'turnover_candidate' END AS event_type FROM (
SELECT *, lag(player_id) OVER w AS a, lag(team) OVER w AS was FROM static_best WINDOW w AS (PARTITION BY match_id ORDER BY frame)) WHERE a IS NULL OR a <> player_id OR was <> team""",
)
define("pred", "SELECT DISTINCT match_id, event_type, frame FROM video_kinds")
define("refs", f"SELECT DISTINCT match_id, {_kind} AS event_type, start_frame FROM annotated")


def static_candidates(t):
    """Candidate events at changes of the memoryless possessor."""
    order = Window.partitionBy("match_id").orderBy("frame")
    h = holders(t).withColumns({"a": F.lag("player_id").over(order), "was": F.lag("team").over(order)})
    h = h.where(F.col("a").isNull() | (F.col("a") != F.col("player_id")) | (F.col("was") != F.col("team")))
    kind = F.when(F.col("was").isNull(), "recovery_candidate").when(F.col("was") == F.col("team"), "pass_candidate").otherwise("turnover_candidate")
    return h.select("match_id", "frame", kind.alias("event_type"))


def _pairs(tol: int) -> str:
    return f"SELECT p.match_id, p.event_type, p.frame AS pred, r.start_frame AS ref, abs(p.frame - r.start_frame) AS diff FROM pred p JOIN refs r ON r.match_id = p.match_id AND r.event_type = p.event_type AND abs(p.frame - r.start_frame) <= {tol}"


def _greedy(tol: int, rounds_: int = 16, k: str = "", pairs: str = "", keys: tuple[str, ...] = ("match_id", "event_type")) -> str:
    """CTEs p<k>, m<k> for rounds of pairs that are first for both their ends."""
    k, own, same = k or f"t{tol}", ", ".join(keys), " AND ".join(f"m.{x} = p.{x}" for x in keys)
    out = [f"{k}p0 AS MATERIALIZED ({pairs or _pairs(tol)})"]
    for i in range(rounds_):
        out.append(f"{k}m{i} AS MATERIALIZED (SELECT * FROM {k}p{i} QUALIFY row_number() OVER (PARTITION BY {own}, pred ORDER BY diff, pred, ref) = 1 AND row_number() OVER (PARTITION BY {own}, ref ORDER BY diff, pred, ref) = 1)")
        out.append(f"{k}p{i + 1} AS MATERIALIZED (SELECT * FROM {k}p{i} p WHERE NOT EXISTS (SELECT 1 FROM {k}m{i} m WHERE {same} AND (m.pred = p.pred OR m.ref = p.ref)))")
    out.append(f"{k} AS ({' UNION ALL '.join(f'SELECT * FROM {k}m{i}' for i in range(rounds_))})")
    return ", ".join(out)


@query("event_pairs_tolerance", _pairs(5))
def _(spark, d):
    a, b = matching.typed(static_candidates(tracking(spark, d)), reference_events(spark, d))
    return matching.tolerance_pairs(a, b, 5, ["match_id", "event_type"])


@query("event_matching", f", {_greedy(5)} SELECT * FROM t5")
def _(spark, d):
    a, b = matching.typed(static_candidates(tracking(spark, d)), reference_events(spark, d))
    return matching.match_greedy(matching.tolerance_pairs(a, b, 5, ["match_id", "event_type"]), ["match_id", "event_type"])


@query(
    "event_prf",
    f""", {_greedy(5)}, {_greedy(12)},
x AS (SELECT 0.2::DOUBLE AS tolerance, * FROM t5 UNION ALL SELECT 0.5::DOUBLE, * FROM t12),
n AS (SELECT tolerance, event_type, coalesce(a.n, 0) AS n_predicted, coalesce(b.n, 0) AS n_reference FROM (SELECT unnest([0.2::DOUBLE, 0.5::DOUBLE]) AS tolerance) CROSS JOIN (SELECT event_type, count(*) AS n FROM pred GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) AS n FROM refs GROUP BY 1) b USING (event_type)),
y AS (SELECT n.*, coalesce(c.tp, 0) AS tp, coalesce(c.e, 0) AS e FROM n LEFT JOIN (SELECT tolerance, event_type, count(*) AS tp, sum(diff) AS e FROM x GROUP BY ALL) c USING (tolerance, event_type)),
z AS (SELECT tolerance, coalesce(event_type, 'ALL') AS event_type, CAST(sum(n_predicted) AS BIGINT) AS n_predicted, CAST(sum(n_reference) AS BIGINT) AS n_reference, CAST(sum(tp) AS BIGINT) AS tp, sum(e) AS e FROM y GROUP BY GROUPING SETS ((tolerance), (tolerance, event_type))),
r AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp / CAST(n_predicted AS DOUBLE) ELSE 0 END AS p, CASE WHEN n_reference > 0 THEN tp / CAST(n_reference AS DOUBLE) ELSE 0 END AS q FROM z)
SELECT tolerance, event_type, n_predicted, n_reference, tp, n_predicted - tp AS fp, n_reference - tp AS fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, round(CASE WHEN tp > 0 THEN e / CAST(tp AS DOUBLE) / 25 ELSE 0 END, 6) AS mean_error_seconds FROM r""",
)
def _(spark, d):
    out = matching.precision_recall(static_candidates(tracking(spark, d)), reference_events(spark, d), (0.2, 0.5))
    return rounded(out, "precision", "recall", "f1", "mean_error_seconds")


define("all_changes", "SELECT DISTINCT match_id, frame FROM video_kinds WHERE event_type <> 'recovery_candidate'")
define("all_refs", "SELECT DISTINCT match_id, start_frame FROM annotated WHERE event_type IN ('PASS', 'BALL LOST', 'BALL OUT', 'RECOVERY')")


@query(
    "change_metrics",
    f""", {_greedy(25, 40, 'pool', 'SELECT p.match_id, p.frame AS pred, r.start_frame AS ref, abs(p.frame - r.start_frame) AS diff FROM all_changes p JOIN all_refs r ON r.match_id = p.match_id AND abs(p.frame - r.start_frame) <= 25', ('match_id',))},
counted AS (SELECT match_id, coalesce(a.n, 0) AS n_predicted, coalesce(b.n, 0) AS n_reference, coalesce(c.n, 0) AS tp FROM (SELECT match_id, count(*) AS n FROM all_changes GROUP BY 1) a FULL JOIN (SELECT match_id, count(*) AS n FROM all_refs GROUP BY 1) b USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM pool GROUP BY 1) c USING (match_id)),
rated AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp / CAST(n_predicted AS DOUBLE) ELSE 0 END AS p, CASE WHEN n_reference > 0 THEN tp / CAST(n_reference AS DOUBLE) ELSE 0 END AS q FROM counted)
SELECT match_id, n_predicted, n_reference, tp, n_predicted - tp AS fp, n_reference - tp AS fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM rated""",
)
def _(spark, d):
    return rounded(matching.change_metrics(static_candidates(tracking(spark, d)), reference_events(spark, d)), "precision", "recall", "f1")


# -- statistics -----------------------------------------------------------------------------------

define("runs", "SELECT 'CLEAN' AS condition, match_id, round(completeness, 9) AS v FROM quality_rows UNION ALL SELECT 'SYNTHETIC-DEGRADED', match_id, round(completeness, 9) FROM q_degraded UNION ALL SELECT 'NOISE-MITIGATED', match_id, round(completeness, 9) FROM q_mitigated")
define("wide", "SELECT match_id, max(v) FILTER (condition = 'CLEAN') AS c, max(v) FILTER (condition = 'SYNTHETIC-DEGRADED') AS w, max(v) FILTER (condition = 'NOISE-MITIGATED') AS b FROM runs GROUP BY match_id")
CONDITIONS = ("CLEAN", "SYNTHETIC-DEGRADED", "NOISE-MITIGATED")


def runs(spark, d):
    parts = [quality.tracking_quality(t).select(F.lit(c).alias("condition"), "match_id", F.round("completeness", 9).alias("v")) for c, t in conditions(spark, d).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("condition_pivot", 'SELECT match_id, c AS "CLEAN", w AS "SYNTHETIC-DEGRADED", b AS "NOISE-MITIGATED" FROM wide')
def _(spark, d):
    return stats.pivot_conditions(runs(spark, d), ["match_id"], "v", CONDITIONS)


@query("condition_summary", f"SELECT condition, count(v) AS n, {rounds('mean', 'median', 'std', 'ci_half')}, min, max FROM (SELECT condition, v, avg(v) OVER (PARTITION BY condition) AS x FROM runs) r JOIN (SELECT condition, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, 1.96::DOUBLE * stddev_samp(v) / sqrt(count(v)) AS ci_half FROM runs GROUP BY condition) s USING (condition) GROUP BY condition, mean, median, std, ci_half, min, max")
def _(spark, d):
    return rounded(stats.describe(runs(spark, d), ["condition"], "v"), "mean", "median", "std", "ci_half")


@query(
    "recovery_fraction",
    "SELECT round(avg(c - w), 6) AS mean_drop, round(avg(b - w), 6) AS mean_gain, round(avg(b - w) / avg(c - w), 6) AS recovery_of_means, round(avg(CASE WHEN abs(c - w) > 1e-12 THEN (b - w) / (c - w) END), 6) AS mean_recovery FROM wide",
)
def _(spark, d):
    return rounded(stats.recovery(runs(spark, d), ["match_id"], "v", *CONDITIONS), "mean_drop", "mean_gain", "recovery_of_means", "mean_recovery")


@query("paired_effect", "SELECT count(*) AS n, round(avg(b - w), 6) AS mean_difference, round(stddev_samp(b - w), 6) AS std, round(avg(b - w) / stddev_samp(b - w), 6) AS cohens_d FROM wide")
def _(spark, d):
    return rounded(stats.paired_effect(runs(spark, d), ["match_id"], "v", "SYNTHETIC-DEGRADED", "NOISE-MITIGATED"), "mean_difference", "std", "cohens_d")


@query(
    "bootstrap_ci",
    f""", o AS (SELECT condition, v, row_number() OVER (PARTITION BY condition ORDER BY match_id) - 1 AS i, count(*) OVER (PARTITION BY condition) AS n FROM runs),
g AS (SELECT condition, r, CAST(floor({u(42, 'boot', 'condition', 'r', 'i')} * n) AS BIGINT) AS i FROM (SELECT condition, i, n, unnest(range(1, 501)) AS r FROM o)),
m AS (SELECT g.condition, r, avg(v) AS m FROM g JOIN o ON o.condition = g.condition AND o.i = g.i GROUP BY ALL)
SELECT condition, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY condition""",
)
def _(spark, d):
    return rounded(stats.bootstrap_interval(runs(spark, d), "condition", "match_id", "v", 500), "low", "high")


@query(
    "experiment_grid",
    """SELECT match_id, w.window_label || '_seed' || s.seed || '_' || v.severity AS run_id, w.window_label, first_frame, last_frame, n_frames, s.seed, v.severity
FROM (SELECT match_id, window_label, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames FROM (SELECT DISTINCT match_id, frame FROM tracking) JOIN (VALUES ('0_1s', 1, 25), ('1_2s', 26, 50), ('2_4s', 51, 100), ('4_60s', 101, 1500)) t(window_label, start_frame, end_frame) ON frame BETWEEN start_frame AND end_frame GROUP BY ALL) w,
(SELECT unnest([72, 73, 74, 75, 76]) AS seed) s, (SELECT unnest(['mild', 'moderate', 'severe']) AS severity) v""",
)
def _(spark, d):
    """The runs of each match, windows clipped to its frames."""
    grid = experiment.make_grid(spark, [(0, 1), (1, 2), (2, 4), (4, 60)], [72, 73, 74, 75, 76], ["mild", "moderate", "severe"])
    return experiment.match_runs(grid, tracking(spark, d))


@query(
    "anomaly_rates",
    "SELECT match_id, team, player_id, count(*) AS n, count(*) FILTER (step > 0.05) AS anomalies, round(count(*) FILTER (step > 0.05) / CAST(count(*) AS DOUBLE), 6) AS rate FROM steps_of GROUP BY ALL",
)
def _(spark, d):
    return rounded(stats.anomaly_rates(quality.with_steps(tracking(spark, d)), ["match_id", "team", "player_id"]), "rate")


# -- serving --------------------------------------------------------------------------------------


@query("possession_timeline_sampled", f"SELECT match_id, frame, team, player_id FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS r, count(*) OVER (PARTITION BY match_id) AS n FROM static_best) WHERE (r - 1) % 10 = 0 OR r = n")
def _(spark, d):
    return serve.sampled_frames(holders(tracking(spark, d)), 10)


@query("players_latest", f"SELECT match_id, frame, {rounds('timestamp')}, player_id, team, x, y, confidence, visible FROM vis QUALIFY row_number() OVER (PARTITION BY match_id, team, player_id ORDER BY frame DESC) = 1")
def _(spark, d):
    return rounded(serve.latest_rows(tracking(spark, d)), "timestamp")


@query("trajectory", f"SELECT match_id, frame, {rounds('timestamp')}, player_id, team, x, y, confidence, visible FROM tracking WHERE match_id = '2' AND player_id = '45' ORDER BY frame LIMIT 40")
def _(spark, d):
    return rounded(serve.trajectory(tracking(spark, d), "2", "45", 40), "timestamp")


@query("nearest_frame", f"SELECT match_id, frame, {rounds('timestamp')}, player_id, team, x, y, confidence, visible FROM tracking WHERE match_id = '3' AND frame = 70")
def _(spark, d):
    return rounded(serve.nearest_frame(tracking(spark, d), "3", 70), "timestamp")


@query("frame_map")
def _(spark, d):
    return serve.frame_map(tracking(spark, d))


@query("team_mode", "SELECT match_id, team, event_type, n FROM (SELECT match_id, team, event_type, count(*) AS n FROM all_rows GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY match_id, team ORDER BY n DESC, event_type) = 1")
def _(spark, d):
    return serve.team_modes(tracking_from_events(spark.read.parquet(f"{d}/events.parquet")), "event_type")


# -- display --------------------------------------------------------------------------------------

define("m", "SELECT * REPLACE (x * 105 AS x, y * 68 AS y) FROM vis")
define("mpairs", "SELECT a.match_id, a.frame, a.team, a.player_id, a.team = b.team AS same_team, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM m a JOIN m b ON a.match_id = b.match_id AND a.frame = b.frame AND (a.team <> b.team OR a.player_id <> b.player_id)")


@query(
    "pressure_support_ui",
    "SELECT match_id, frame, team, player_id, round(least(1, coalesce(sum(exp(-dist / 6)) FILTER (NOT same_team), 0) / 2.4::DOUBLE), 6) AS pressure, round(least(1, coalesce(sum(exp(-dist / 12)) FILTER (same_team), 0) / 4.2::DOUBLE), 6) AS support, count(*) FILTER (dist <= 10) AS density FROM mpairs GROUP BY ALL",
)
def _(spark, d):
    return rounded(pitch.pressure_support(tracking(spark, d)), "pressure", "support")


@query(
    "team_geometry_ui",
    f"""SELECT match_id, frame, team, {rounds('centroid_x', 'centroid_y', 'width', 'length', 'spread')}, round(1 / (1 + spread / 12), 6) AS compactness FROM (
SELECT match_id, frame, team, avg(x) AS centroid_x, avg(y) AS centroid_y, max(y) - min(y) AS width, max(x) - min(x) AS length, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS spread
FROM (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM m WINDOW w AS (PARTITION BY match_id, frame, team)) GROUP BY ALL)""",
)
def _(spark, d):
    return rounded(pitch.team_shape(tracking(spark, d)), "centroid_x", "centroid_y", "width", "length", "spread", "compactness")


@query(
    "ui_pass_score",
    f"SELECT {STATE}, target_player_id, round(0.34::DOUBLE * {clip('target_space / 0.3::DOUBLE', 0, 1)} + 0.26::DOUBLE * {clip('target_pressure / 0.3::DOUBLE', 0, 1)} + 0.22::DOUBLE * (1 - {clip('obstruction / 3.0::DOUBLE', 0, 1)}) + 0.18::DOUBLE * ({clip('forward_progress', -0.5, 0.5)} + 0.5::DOUBLE), 6) AS display_score FROM cand_rows",
)
def _(spark, d):
    return rounded(pitch.display_pass_score(candidates(tracking(spark, d))), "display_score").select(*STATE.split(", "), "target_player_id", "display_score")


_L = ("match_id", "frame", "team", "player_id")


@query(
    "noise_lab",
    f"""SELECT match_id, frame, team, player_id, round({clip(f"x + (2 * {u(7, 'move_x', *_L)} - 1) * 2", 0, 105)}, 6) AS x, round({clip(f"y + (2 * {u(7, 'move_y', *_L)} - 1) * 2", 0, 68)}, 6) AS y FROM (
SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY {u(7, 'drop', *_L)}, team, player_id) AS r, count(*) OVER (PARTITION BY match_id, frame) AS n FROM m) WHERE r > round_even(n * 15 / 100.0::DOUBLE, 0)""",
)
def _(spark, d):
    return rounded(pitch.noise_lab(tracking(spark, d), 15.0, 2.0), "x", "y").select("match_id", "frame", "team", "player_id", "x", "y")


H = pitch.four_point_homography([(0.1, 0.2), (0.9, 0.25), (0.95, 0.9), (0.05, 0.85)], [(0, 0), (1, 0), (1, 1), (0, 1)])


@query(
    "homography_projection",
    f"""SELECT match_id, frame, team, player_id, round(px, 6) AS px, round(py, 6) AS py, coalesce(px BETWEEN -0.05 AND 1.05 AND py BETWEEN -0.05 AND 1.05, false) AS on_pitch FROM (
SELECT *, ({float(H[0, 0])!r}::DOUBLE * x + {float(H[0, 1])!r}::DOUBLE * y + {float(H[0, 2])!r}::DOUBLE) / w AS px, ({float(H[1, 0])!r}::DOUBLE * x + {float(H[1, 1])!r}::DOUBLE * y + {float(H[1, 2])!r}::DOUBLE) / w AS py
FROM (SELECT *, {float(H[2, 0])!r}::DOUBLE * x + {float(H[2, 1])!r}::DOUBLE * y + {float(H[2, 2])!r}::DOUBLE AS w FROM vis))""",
)
def _(spark, d):
    x, y, on = pitch.project(F.col("x"), F.col("y"), H, 0.05)
    return tracking(spark, d).where("visible").select("match_id", "frame", "team", "player_id", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"), on.alias("on_pitch"))


define(
    "tracklets",
    """SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY first_frame, last_frame, player_id) AS n FROM (
SELECT match_id, team, player_id || '_' || run AS player_id, min(frame) AS first_frame, max(frame) AS last_frame, arg_min(x, frame) AS first_x, arg_min(y, frame) AS first_y, arg_max(x, frame) AS last_x, arg_max(y, frame) AS last_y
FROM (SELECT *, sum(fresh) OVER (PARTITION BY match_id, team, player_id ORDER BY frame) AS run FROM (
  SELECT *, CASE WHEN lag(frame) OVER (PARTITION BY match_id, team, player_id ORDER BY frame) IS DISTINCT FROM frame - 1 THEN 1 ELSE 0 END AS fresh FROM vis))
GROUP BY match_id, team, player_id, run)""",
)
_distance = "round(sqrt(pow((first_x - z.x) * 105::DOUBLE, 2) + pow((first_y - z.y) * 68::DOUBLE, 2)), 9)"
define(
    "stitches",
    f"""SELECT match_id, team, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS own, CAST([] AS STRUCT(k VARCHAR, last BIGINT, x DOUBLE, y DOUBLE)[]) AS tails FROM (SELECT DISTINCT match_id, team FROM tracklets)
UNION ALL
SELECT match_id, team, n, own, CASE WHEN len(list_filter(live, lambda z: z.k = own AND z.last > last_frame)) > 0 THEN live
  ELSE list_append(list_filter(live, lambda z: z.k <> own), {{'k': own, 'last': CAST(last_frame AS BIGINT), 'x': last_x, 'y': last_y}}) END
FROM (SELECT *, coalesce(list_min(list_transform(list_filter(live, lambda z: first_frame - z.last >= -15 AND {_distance} <= 3.5::DOUBLE + 7.5::DOUBLE * greatest(first_frame - z.last, 0) / 25::DOUBLE), lambda z: {{'d': {_distance}, 'k': z.k}})).k, player_id) AS own
  FROM (SELECT t.*, list_filter(p.tails, lambda z: t.first_frame - z.last <= 120) AS live FROM stitches p JOIN tracklets t ON t.match_id = p.match_id AND t.team = p.team AND t.n = p.n + 1))""",
)


@query("tracklet_stitch", "SELECT t.* EXCLUDE (n), s.own AS stitched_id FROM tracklets t JOIN stitches s ON s.match_id = t.match_id AND s.team = t.team AND s.n = t.n")
def _(spark, d):
    """Visible runs of the tracks as tracklets."""
    t = quality.with_steps(tracking(spark, d))
    runs_ = t.withColumn("fresh", F.col("step").isNull().cast("int")).withColumn("run", F.sum("fresh").over(Window.partitionBy("match_id", "team", "player_id").orderBy("frame")))
    ends = runs_.groupBy("match_id", "team", "player_id", "run").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min_by("x", "frame").alias("first_x"), F.min_by("y", "frame").alias("first_y"), F.max_by("x", "frame").alias("last_x"), F.max_by("y", "frame").alias("last_y")
    )
    return pitch.stitch_tracklets(ends.withColumn("player_id", F.concat_ws("_", "player_id", "run")).drop("run"))
