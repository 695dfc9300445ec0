"""Queries on tables derived from the adapter's: whole track repair, kits and colours, files of many matches, reports, intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import colours
from trackloom.functions.hashing import uniform
from trackloom.operators import kits, pitch, stats, tracks
from trackloom.operators.repair import fit_rows
from trackloom.oracles.core import clip, define, sql, u
from trackloom.plans import experiment
from trackloom.queries_core import rounded, rounds
from trackloom.queries_passes import runs
from trackloom.sources import files, matches
from trackloom.sources.adapter import tracking
from trackloom.sources.shared import TASKS, work_folder

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return add


# -- tracks ---------------------------------------------------------------------------------------
# Each player walks along a line of the pitch and is seen as a tracklet per 20 frames, the last three of them hidden;
# a tracklet goes on for three frames into the next. An official stands on the touchline.

define(
    "walkers",
    """SELECT match_id, frame, team, player_id, confidence, CAST(floor(frame / 20.0) AS BIGINT) AS piece, 0.3::DOUBLE + 0.02::DOUBLE * sin(frame / 80.0::DOUBLE) AS x, 0.06::DOUBLE + 0.075::DOUBLE * k AS y
FROM (SELECT *, dense_rank() OVER (PARTITION BY match_id, team ORDER BY player_id) AS k FROM tracking) WHERE visible AND k <= 11""",
)
define(
    "planted",
    """SELECT match_id, frame, team, player_id AS orig, player_id || '_' || piece AS player_id, x, y, CASE WHEN frame % 2 = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM walkers WHERE frame % 20 < 17
UNION ALL SELECT match_id, frame, team, player_id, player_id || '_' || (piece - 1), x + 0.001::DOUBLE, y, 0.5::DOUBLE FROM walkers WHERE frame % 20 < 3 AND piece > 0
UNION ALL SELECT match_id, frame, team, 'line', 'line', x, 0.99::DOUBLE, 1::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY match_id, team, frame ORDER BY player_id) AS r FROM walkers) WHERE r = 1""",
)
define("whole_pieces", "SELECT match_id, team, player_id, orig, min(frame) AS first_frame FROM planted GROUP BY ALL HAVING count(*) >= 2 AND orig <> 'line'")
define(
    "one_a_frame",
    """SELECT p.match_id, p.frame, p.team, first_value(p.player_id) OVER (PARTITION BY p.match_id, p.team, p.orig ORDER BY first_frame, p.player_id, p.frame) AS player_id, x, y, confidence
FROM planted p JOIN whole_pieces w ON w.match_id = p.match_id AND w.team = p.team AND w.player_id = p.player_id QUALIFY row_number() OVER (PARTITION BY p.match_id, p.team, p.orig, p.frame ORDER BY first_frame, p.player_id) = 1""",
)
define("match_frames", "SELECT match_id, unnest(range(0, last + 1)) AS frame FROM (SELECT match_id, max(frame) AS last FROM planted GROUP BY match_id)")


def _framed(source: str) -> str:
    before = "(PARTITION BY match_id, team, player_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = "(PARTITION BY match_id, team, player_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near = ", ".join(f"last_value({v} IGNORE NULLS) OVER {before} AS a_{c}, first_value({v} IGNORE NULLS) OVER {after} AS b_{c}" for c, v in [("f", "seen"), *[(c, c) for c in ("x", "y", "confidence")]])
    return f"""SELECT *, {near} FROM (SELECT t.match_id, t.team, t.player_id, f.frame, s.frame AS seen, x, y, confidence FROM (SELECT DISTINCT match_id, team, player_id FROM {source}) t JOIN match_frames f USING (match_id)
LEFT JOIN {source} s ON s.match_id = t.match_id AND s.team = t.team AND s.player_id = t.player_id AND s.frame = f.frame)"""


def _line(c: str) -> str:
    return f"a_{c} + CASE WHEN b_f > a_f THEN (frame - a_f) / CAST(b_f - a_f AS DOUBLE) ELSE 0 END * (b_{c} - a_{c})"


define("bridges", _framed("one_a_frame"))
define("side_scores", "SELECT match_id, team, player_id, row_number() OVER (PARTITION BY match_id, team ORDER BY count(*) * avg(confidence) DESC, player_id) AS number FROM one_a_frame GROUP BY match_id, team, player_id HAVING count(*) >= 8")
define("picked", "SELECT o.match_id, o.frame, o.team, upper(replace(o.team, ' ', '_')) || '_' || number AS player_id, x, y, confidence FROM one_a_frame o JOIN side_scores s ON s.match_id = o.match_id AND s.team = o.team AND s.player_id = o.player_id WHERE number <= 11")
define("picked_frames", _framed("picked"))
_places = ", ".join(f"({i + 1}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (x, y) in enumerate(tracks.PLACES))
define(
    "squad_rows",
    f"""SELECT match_id, frame, team, player_id, coalesce({_line("x")}, a_x, b_x) AS x, coalesce({_line("y")}, a_y, b_y) AS y, CASE WHEN x IS NULL THEN 0.75::DOUBLE ELSE confidence END AS confidence, x IS NULL AS imputed FROM picked_frames
UNION ALL SELECT d.match_id, f.frame, d.team, upper(replace(d.team, ' ', '_')) || '_' || p.number, CASE WHEN d.side = 1 THEN p.x ELSE 1 - p.x END, CASE WHEN d.side = 1 THEN p.y ELSE 1 - p.y END, 0.6::DOUBLE, true
FROM (SELECT match_id, team, row_number() OVER (PARTITION BY match_id ORDER BY team <> 'home', team) AS side FROM (SELECT DISTINCT match_id, team FROM side_scores)) d, (VALUES {_places}) p(number, x, y) JOIN match_frames f ON f.match_id = d.match_id
WHERE NOT EXISTS (SELECT 1 FROM side_scores s WHERE s.match_id = d.match_id AND s.team = d.team AND s.number = p.number)""",
)


def _smoothed(c: str, size: int = 9) -> str:
    h = fit_rows(size, 2)
    at = lambda row: " + ".join(f"CAST({float(h[row, j])!r} AS DOUBLE) * " + (f"lead({c}, {j - row}) OVER w" if j > row else f"lag({c}, {row - j}) OVER w" if j < row else c) for j in range(size))
    ends = " ".join(f"WHEN i = {e} THEN {at(e)} WHEN n - 1 - i = {e} THEN {at(size - 1 - e)}" for e in range(size // 2))
    return f"CASE WHEN n < {size} THEN {c} {ends} ELSE {at(size // 2)} END"


def planted(spark, d):
    t = tracking(spark, d).where("visible").withColumn("k", F.dense_rank().over(Window.partitionBy("match_id", "team").orderBy("player_id")))
    t = tracking(spark, d).select("match_id", "team", "player_id").distinct().withColumn("k", F.dense_rank().over(Window.partitionBy("match_id", "team").orderBy("player_id"))).where("k <= 11").join(t.drop("k"), ["match_id", "team", "player_id"])
    t = t.withColumns({"x": 0.3 + 0.02 * F.sin(F.col("frame") / 80.0), "y": 0.06 + 0.075 * F.col("k"), "piece": F.floor(F.col("frame") / 20)})
    part = lambda rows, name, x, confidence: rows.select("match_id", "frame", "timestamp", name.alias("player_id"), "team", x.alias("x"), "y", confidence.alias("confidence"), "visible")
    named = lambda n: F.concat_ws("_", "player_id", n.cast("string"))
    own = part(t.where("frame % 20 < 17"), named(F.col("piece")), F.col("x"), F.when(F.col("frame") % 2 == 0, 0.5).otherwise(0.75))
    longer = part(t.where("frame % 20 < 3 AND piece > 0"), named(F.col("piece") - 1), F.col("x") + 0.001, F.lit(0.5))
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("match_id", "team", "frame").orderBy("player_id"))).where("r = 1").withColumn("y", F.lit(0.99))
    return own.unionByName(longer).unionByName(part(first, F.lit("line"), F.col("x"), F.lit(1.0)))


@query(
    "bridged_tracks",
    f"SELECT match_id, frame, round(frame / 25::DOUBLE, 4) AS timestamp, player_id, team, round({_line('x')}, 6) AS x, round({_line('y')}, 6) AS y, round({_line('confidence')}, 6) AS confidence, true AS visible FROM bridges WHERE x IS NOT NULL OR b_f - a_f - 1 <= 10",
)
def _(spark, d):
    """Tracklets stitched to tracks, their short gaps filled."""
    return rounded(tracks.bridge_tracks(planted(spark, d)), "x", "y", "confidence")


@query(
    "squads",
    f"""SELECT match_id, frame, round(frame / 25::DOUBLE, 4) AS timestamp, player_id, team, round({clip('sx', 0.005, 0.995)}, 6) AS x, round({clip('sy', 0.005, 0.995)}, 6) AS y, confidence, true AS visible, imputed FROM (
SELECT *, {_smoothed('x')} AS sx, {_smoothed('y')} AS sy FROM (SELECT *, count(*) OVER (PARTITION BY match_id, team, player_id) AS n, row_number() OVER (PARTITION BY match_id, team, player_id ORDER BY frame) - 1 AS i FROM squad_rows)
WINDOW w AS (PARTITION BY match_id, team, player_id ORDER BY frame))""",
)
def _(spark, d):
    """Eleven a side on every frame, the best stitched tracks first."""
    return rounded(tracks.squads(planted(spark, d)), "x", "y")


# -- kits and colours -----------------------------------------------------------------------------


@query(
    "kits_with_referees",
    """SELECT match_id, player_id, CASE WHEN NOT is_referee THEN side = first_side END AS with_first, is_referee FROM (
SELECT *, first_value(side) OVER (PARTITION BY match_id ORDER BY is_referee, player_id) AS first_side FROM (
SELECT match_id, player_id, side, player_id = 'referee' OR (player_id = 'white' AND least(2, greatest(1, count(*) OVER (PARTITION BY match_id) // 8)) = 2) AS is_referee FROM (
SELECT DISTINCT match_id, player_id, team AS side FROM vis UNION ALL SELECT DISTINCT match_id, unnest(['referee', 'white']), 'home' FROM vis))) WHERE match_id IN (SELECT match_id FROM vis GROUP BY match_id HAVING count(DISTINCT team) = 2)""",
)
def _(spark, d):
    """Shirts in red and blue, a referee in turquoise, and a player in white: odd enough for a referee where a match may have two, else nearest to red."""
    t = tracking(spark, d).where("visible").select("match_id", "player_id", "frame", "team")
    both = t.groupBy("match_id").agg(F.count_distinct("team").alias("n")).where("n = 2").drop("n")
    t = t.join(both, "match_id", "left_semi")
    extra = both.withColumn("player_id", F.explode(F.array(F.lit("referee"), F.lit("white")))).withColumns({"frame": F.explode(F.sequence(F.lit(1), F.lit(9))), "team": F.col("player_id")})
    base = {"home": (200, 40, 40), "away": (30, 60, 200), "referee": (40, 190, 205), "white": (235, 235, 235)}
    noise = lambda c: 20.0 * (uniform(7, c, "match_id", "player_id", "frame") - 0.5)
    shade = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in base.items() for x in (k, float(v[i]))]), F.col("team")) + noise("rgb"[i])
    samples = t.unionByName(extra).select("match_id", "player_id", *[shade(i).alias("rgb"[i]) for i in range(3)])
    return kits.fit_sides(samples).select("match_id", "player_id", (F.col("cluster") == 0).alias("with_first"), "is_referee")


def _named(p: str) -> str:
    bound = lambda v, lo, hi: f"{p}{v} BETWEEN {lo} AND {hi}"
    return "CASE " + " ".join("WHEN " + " AND ".join(bound(v, *r) for v, r in zip("hsv", rule[:3], strict=True)) + f" THEN '{rule[3]}'" for rule in colours.KITS) + " ELSE 'Red' END"


def _hsv(p: str) -> str:
    most, gap = f"greatest({p}r, {p}g, {p}b)", f"(greatest({p}r, {p}g, {p}b) - least({p}r, {p}g, {p}b))::DOUBLE"
    turn = f"CASE WHEN {gap} = 0 THEN 0 WHEN {most} = {p}r THEN ({p}g - {p}b) / {gap} WHEN {most} = {p}g THEN ({p}b - {p}r) / {gap} + 2 ELSE ({p}r - {p}g) / {gap} + 4 END"
    return f"floor(30 * ({turn}) + 0.5) + CASE WHEN floor(30 * ({turn}) + 0.5) < 0 THEN 180 ELSE 0 END AS {p}h, CASE WHEN {most} = 0 THEN 0 ELSE floor(255 * {gap} / {most} + 0.5) END AS {p}s, {most} AS {p}v"


SHADES = {"r": "event_id * 37 % 256", "g": "event_id * 101 // 7 % 256", "b": "event_id * 53 // 3 % 256"}


@query(
    "kit_names",
    f"""SELECT event_id, name, other, CASE WHEN name <> other THEN name WHEN name IN ('Blue', 'Navy', 'Sky Blue') THEN CASE WHEN light >= 0 THEN 'Sky Blue' ELSE 'Navy' END WHEN light > 0 THEN 'Light ' || name ELSE 'Dark ' || name END AS first_side,
CASE WHEN name <> other THEN other WHEN name IN ('Blue', 'Navy', 'Sky Blue') THEN CASE WHEN light >= 0 THEN 'Navy' ELSE 'Sky Blue' END WHEN light > 0 THEN 'Dark ' || name ELSE 'Light ' || name END AS second_side FROM (
SELECT event_id, {_named('')} AS name, {_named('o_')} AS other, light FROM (SELECT event_id, {_hsv('')}, {_hsv('o_')}, 299 * (r - o_r) + 587 * (g - o_g) + 114 * (b - o_b) AS light FROM (
SELECT *, r // 16 * 16 AS o_r, g // 16 * 16 + 9 AS o_g, b // 16 * 16 + 9 AS o_b FROM (SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in SHADES.items())} FROM events))))""",
)
def _(spark, d):
    """A colour of each event and one near it: their names, and those of two sides in them."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", *[F.expr(v.replace("//", "DIV")).alias(k) for k, v in SHADES.items()])
    own, other = [F.col(c) for c in "rgb"], [F.floor(F.col(c) / 16) * 16 + add for c, add in zip("rgb", (0, 9, 9), strict=True)]
    light = sum((w * (a - b) for w, a, b in zip((299, 587, 114), own, other, strict=True)), F.lit(0))
    e = e.select("event_id", colours.kit_name(*own).alias("name"), colours.kit_name(*other).alias("other"), light.alias("light"))
    first, second = colours.told_apart(F.col("name"), F.col("other"), F.col("light"))
    return e.select("event_id", "name", "other", first.alias("first_side"), second.alias("second_side"))


def _fnv(text: str) -> str:
    return f"(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295::BIGINT) / 4294967295::DOUBLE)"


@query(
    "display_noise",
    f"""SELECT match_id, frame, team, player_id, round({clip("105 * x + (2 * " + _fnv("frame || ':' || player_id || ':x'") + " - 1) * 0.4::DOUBLE", 0, 105)}, 6) AS x, round({clip("68 * y + (2 * " + _fnv("frame || ':' || player_id || ':y'") + " - 1) * 0.4::DOUBLE", 0, 68)}, 6) AS y
FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY {_fnv("frame || ':' || player_id || ':drop'")}, team, player_id) AS r, count(*) OVER (PARTITION BY match_id, frame) AS n FROM vis) WHERE r > floor(n * 8 / 100.0::DOUBLE + 0.5)""",
)
def _(spark, d):
    return rounded(pitch.display_noise(tracking(spark, d), 8, 0.4), "x", "y").select("match_id", "frame", "team", "player_id", "x", "y")


# -- intervals and order --------------------------------------------------------------------------


@query(
    "paired_interval",
    f""", pairs_of AS (SELECT b - w AS d, row_number() OVER (ORDER BY match_id) - 1 AS i, count(*) OVER () AS n FROM wide WHERE b - w IS NOT NULL),
draws_of AS (SELECT r, CAST(floor({u(1234, 'pairs', 'r', 'i')} * n) AS BIGINT) AS i FROM (SELECT i, n, unnest(range(1, 2001)) AS r FROM pairs_of)),
boots AS (SELECT r, avg(d) AS m, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) WHEN avg(d) = 0 THEN 0 ELSE sign(avg(d)) * 'inf'::DOUBLE END AS c FROM draws_of JOIN pairs_of USING (i) GROUP BY r)
SELECT e.*, low, high, d_low, d_high FROM (SELECT count(*) AS n, round(avg(d), 6) AS mean_difference, round(stddev_samp(d), 6) AS std, round(avg(d) / stddev_samp(d), 6) AS cohens_d FROM pairs_of) e,
(SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(quantile_cont(c, 0.025), 6) AS d_low, round(quantile_cont(c, 0.975), 6) AS d_high FROM boots)""",
)
def _(spark, d):
    """2000 resamples of the matches' pairs."""
    out = stats.paired_interval(runs(spark, d), ["match_id"], "v", "SYNTHETIC-DEGRADED", "NOISE-MITIGATED")
    return rounded(out, "mean_difference", "std", "cohens_d", "low", "high", "d_low", "d_high")


LEVELS = {0: 0.0, 1: 0.1, 2: 0.05, 3: 0.4}


@query(
    "severity_order",
    f"""WITH v AS (SELECT match_id, level, measure, value FROM (SELECT match_id, level, round(100 * avg(CAST(gone AS INTEGER)), 6) AS missing, count(*) FILTER (NOT gone)::DOUBLE AS seen, level::DOUBLE AS level_number FROM (
SELECT t.match_id, l.level, NOT visible OR {u(5, 'drop', 't.match_id', 't.frame', 't.team', 't.player_id')} < l.share AS gone FROM tracking t, (VALUES {', '.join(f'({k}, {v}::DOUBLE)' for k, v in LEVELS.items())}) l(level, share)) GROUP BY ALL)
UNPIVOT (value FOR measure IN (missing, seen, level_number))),
w AS (SELECT *, lag(value) OVER (PARTITION BY match_id, measure ORDER BY level) AS was FROM v)
SELECT match_id, measure, count(*) AS n_levels, count(*) FILTER (value < was) = 0 AS rises, CAST(min(level) FILTER (value < was) AS INTEGER) AS first_fall FROM w GROUP BY match_id, measure""".replace("WITH v AS", ", v AS", 1),
)
def _(spark, d):
    """Shares of lost rows by level, one of which is less than that before: do measures follow the levels?"""
    t = tracking(spark, d).withColumn("l", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(v).alias("share")) for k, v in LEVELS.items()])))
    gone = ~F.col("visible") | (uniform(5, "drop", "match_id", "frame", "team", "player_id") < F.col("l.share"))
    rows = t.select("match_id", "l.level", gone.alias("gone")).groupBy("match_id", "level").agg(F.round(100 * F.avg(F.col("gone").cast("int")), 6).alias("missing"), F.count_if(~F.col("gone")).cast("double").alias("seen"), F.max("level").cast("double").alias("level_number"))
    return stats.rises(rows, "level", ["missing", "seen", "level_number"], ["match_id"])


# -- files ----------------------------------------------------------------------------------------


def _wide_lines(t):
    """team, match, line number and line of the tables of one side: two lines, a header, and a row a frame."""
    people = t.groupBy("match_id", "team").agg(F.array_sort(F.collect_set("player_id")).alias("people"))
    join = lambda head, cells: F.concat_ws(",", *head, F.array_join(cells, ","))
    empty = F.array(*[F.lit("")] * 3)
    head = people.select("match_id", "team", F.posexplode(F.array(join([empty], F.transform("people", lambda p: F.concat(F.lit(","), F.lit("")))), join([empty], F.transform("people", lambda p: F.concat(p, F.lit(",")))), join([F.array(*map(F.lit, ("Period", "Frame", "Time [s]")))], F.transform("people", lambda p: F.concat(F.lit("Player"), p, F.lit(",")))))).alias("n", "value"))
    cell = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in ("x", "y")])
    rows = t.groupBy("match_id", "team", "frame").agg(F.min("timestamp").alias("timestamp"), F.map_from_entries(F.collect_list(F.struct("player_id", cell.alias("cell")))).alias("at")).join(people, ["match_id", "team"])
    rows = rows.select("match_id", "team", (F.col("frame") + 2).cast("int").alias("n"), join([F.array(F.lit("1"), F.col("frame").cast("string"), F.col("timestamp").cast("string"))], F.transform("people", lambda p: F.coalesce(F.element_at("at", p), F.lit("NaN,NaN")))).alias("value"))
    return head.unionByName(rows)


@query("many_wide_files", f"SELECT match_id, frame, {rounds('timestamp')}, player_id, team, x, y, CAST(visible AS DOUBLE) AS confidence, visible FROM tracking")
def _(spark, d):
    """Every match's two tables written as files and read again as one table: only frames that a side has are in its file."""
    matches.register(spark)
    folder = work_folder(spark, "wide")
    lines = _wide_lines(tracking(spark, d))
    lines.repartition(TASKS, "match_id", "team").sortWithinPartitions("match_id", "team", "n").select("match_id", "team", "value").write.partitionBy("match_id", "team").text(folder)
    read = spark.read.format("match_files").option("wide", r"match_id=(?P<match>[^/]+)/team=(?P<side>[^/]+)/part-[^/]*$").load(folder)
    spine = tracking(spark, d).select("match_id", "frame", "team", "player_id")
    return rounded(read.join(spine, ["match_id", "frame", "team", "player_id"], "left_semi"), "timestamp").select(*read.columns)


@query("many_frame_files", f"SELECT match_id, frame, {rounds('timestamp')}, player_id, team, {rounds('x', 'y')}, CAST(visible AS DOUBLE) AS confidence, visible FROM tracking")
def _(spark, d):
    """Every match as lines of frames in metres with its description, written as files and read again as one table."""
    matches.register(spark)
    folder = work_folder(spark, "lines")
    t = tracking(spark, d)
    number = F.col("player_id").cast("long")
    seen = F.struct(((F.col("x") - 0.5) * 105.0).alias("x"), ((F.col("y") - 0.5) * 68.0).alias("y"), number.alias("player_id"), F.col("visible").alias("is_detected"))
    frames = t.groupBy("match_id", "frame").agg(F.min("timestamp").cast("string").alias("timestamp"), F.collect_list(seen).alias("player_data"))
    frames.select("match_id", F.to_json(F.struct("frame", "timestamp", "player_data")).alias("value")).repartition("match_id").write.partitionBy("match_id").text(f"{folder}/lines")
    person = F.struct(number.alias("id"), F.when(F.col("team") == "home", 1).otherwise(2).alias("team_id"))
    about = t.groupBy("match_id").agg(F.collect_set(person).alias("players")).select("match_id", F.to_json(F.struct(F.lit(105).alias("pitch_length"), F.lit(68).alias("pitch_width"), F.struct(F.lit(1).alias("id")).alias("home_team"), F.struct(F.lit(2).alias("id")).alias("away_team"), "players")).alias("value"))
    about.repartition("match_id").write.partitionBy("match_id").text(f"{folder}/about")
    name = r"/match_id=(?P<match>[^/]+)/part-[^/]*$"
    read = spark.read.format("match_files").option("kind", "lines").option("lines", "lines" + name).option("meta", "about" + name).load(folder)
    return rounded(read, "timestamp", "x", "y")


@query(
    "run_reconciliation",
    """SELECT 'run' || m AS run_id, CAST(n_reported AS BIGINT) AS n_reported, CAST(n_files AS BIGINT) AS n_files, CASE WHEN n_files = 0 THEN 'MISSING' WHEN n_reported = 0 THEN 'SURPLUS' WHEN n_files > 1 OR n_reported > 1 THEN 'DOUBLED' ELSE 'OK' END AS status
FROM (SELECT m, CASE WHEN m % 4 = 1 THEN 0 ELSE 1 END AS n_reported, CASE m % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n_files FROM (SELECT DISTINCT CAST(player_id AS BIGINT) AS m FROM tracking)) WHERE n_reported + n_files > 0""",
)
def _(spark, d):
    """A run per player: files of two thirds of them, of half of these twice, against a report of three quarters."""
    folder = work_folder(spark, "runs")
    number = F.col("player_id").cast("long")
    r = tracking(spark, d).groupBy(number.alias("m")).agg(F.count("*").alias("rows")).withColumn("run_id", F.concat(F.lit("run"), F.col("m").cast("string")))
    experiment.write_runs(r.where("m % 3 > 0").select("run_id", "rows", F.when(F.col("m") % 3 == 1, 2).otherwise(1).alias("copies")), folder)
    return experiment.reconcile(r.where("m % 4 <> 1").select("run_id"), experiment.result_files(spark, folder, "*.json"))


@query(
    "evaluation_summary",
    f"""SELECT 'gaps' AS result, match_id, NULL::BIGINT AS tracked_rows, NULL::DOUBLE AS mean_x, count(*) FILTER (NOT visible) AS hidden FROM tracking GROUP BY match_id
UNION ALL SELECT 'means', match_id, count(*), round(avg(x), 6), NULL FROM tracking GROUP BY match_id""",
)
def _(spark, d):
    """Two stored results with different columns as one table; a third one isn't there."""
    folder, t = work_folder(spark, "results"), tracking(spark, d)
    files.write_results(t.groupBy("match_id").agg(F.count("*").alias("tracked_rows"), F.round(F.avg("x"), 6).alias("mean_x")), f"{folder}/means")
    files.write_results(t.groupBy("match_id").agg(F.count_if(~F.col("visible")).alias("hidden")), f"{folder}/gaps")
    out = files.evaluation_summary(spark, {n: f"{folder}/{n}/csv" for n in ("means", "gaps", "none")})
    return out.select("result", F.col("match_id").cast("string").alias("match_id"), F.col("tracked_rows").cast("long").alias("tracked_rows"), "mean_x", F.col("hidden").cast("long").alias("hidden"))
