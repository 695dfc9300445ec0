import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import degrade, kits, lookup, pitch
from trackloom.sources import files


def rows(spark, data):
    """Rows of match m: frame, player, team, x, y, visible."""
    t = spark.createDataFrame(data, "frame long, player_id string, team string, x double, y double, visible boolean")
    return t.selectExpr("'m' AS match_id", "frame", "frame / 25D AS timestamp", "player_id", "team", "x", "y", "1.0D AS confidence", "visible")


def test_frame_without_both_sides_is_unavailable(spark):
    t = rows(spark, [(1, "1", "home", 0.4, 0.5, True), (1, "2", "away", 0.5, 0.5, True), (2, "1", "home", 0.4, 0.5, True), (2, "2", "away", None, None, False)])
    got = {r.frame: r for r in lookup.frame_tactics(t).collect()}
    assert got[1].status == "available" and got[1].possessor_id in ("HOME_1", "AWAY_2") and 0 <= got[1].tas <= 1
    assert got[2].status == "unavailable" and got[2].possessor_id is None and got[2].tas is None
    assert [r.frame for r in lookup.possession_at(t, "m", 9).collect()] == [2] and lookup.possession_at(t, "m", 99).count() == 0
    assert lookup.frame_possession(t.limit(0)).count() == 0


def test_ranges_and_tolerances_are_checked(spark):
    t = rows(spark, [(1, "1", "home", 0.4, 0.5, True)])
    for first, last, stride in ((1, 5000, 1), (5, 1, 1), (1, 5, 0)):
        with pytest.raises(ValueError):
            lookup.possession_range(t, "m", first, last, stride)
    with pytest.raises(ValueError):
        lookup.metrics_at(t, 2.0)
    with pytest.raises(ValueError, match="jitter_distribution"):
        degrade.check_config(degrade.SEVERITIES["mild"])
    assert degrade.check_config(degrade.SEVERITIES["mild"] | {"jitter_distribution": "gaussian"})


def test_clip_without_scored_frames(spark):
    got = lookup.clip_summary(rows(spark, [(1, "1", "home", 0.4, 0.5, True)])).collect()
    assert [tuple(r) for r in got] == [("m", 0.0, 0.0, 0.5, 0)]


def test_foot_points_equal_a_running_mean(spark):
    rng = np.random.default_rng(3)
    y = rng.uniform(0, 700, 300)
    b = spark.createDataFrame([("t", i, 0.0, 0.0, float(2 * v), float(v)) for i, v in enumerate(y)], "track string, frame long, x1 double, y1 double, x2 double, y2 double")
    want, mean = [], None
    for v in y:
        mean = v if mean is None else 0.5 * mean + 0.5 * v
        want.append(mean)
    got = pitch.foot_points(b, ["track"]).orderBy("frame").collect()
    assert np.allclose([r.v for r in got], want, rtol=0, atol=1e-9) and np.allclose([r.u for r in got], want, rtol=0, atol=1e-9)


def test_points_near_the_lines_and_the_turf(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    p = spark.createDataFrame([(5.0, 5.0), (13.0, 5.0), (15.0, 5.0), (5.0, -3.0)], "u double, v double")
    got = p.select(pitch.polygon_distance(F.col("u"), F.col("v"), square), pitch.inside_lines(F.col("u"), F.col("v"), 0.0, 10.0, square)).collect()
    assert [tuple(r) for r in got] == [(5.0, True), (-3.0, True), (-5.0, False), (-3.0, True)]
    assert [tuple(r) for r in pitch.on_pitch_only(spark.createDataFrame([(1.01, 0.5), (1.02, 0.5), (0.001, 0.5)], "x double, y double")).collect()] == [(0.995, 0.5), (0.005, 0.5)]
    drift = spark.createDataFrame([(0.5,), (0.497,), (0.45,), (0.9,)], "seen double").select(pitch.drift_shift(F.col("seen"), 0.5)).collect()
    assert [round(r[0], 6) for r in drift] == [0.0, 0.0, 0.009, -0.025]


def test_referee_and_sides(spark):
    kit = {f"a{i}": (200.0, 30.0, 40.0) for i in range(7)} | {f"b{i}": (30.0, 60.0, 200.0) for i in range(7)} | {"ref": (180.0, 220.0, 30.0)}
    samples = [("m", p, r + d, g, b) for p, (r, g, b) in kit.items() for d in (-5.0, 0.0, 5.0)] + [("m", "a0", None, None, None), ("one", "x", 1.0, 2.0, 3.0)]
    got = {(r.match_id, r.player_id): r for r in kits.fit_sides(spark.createDataFrame(samples, "match_id string, player_id string, r double, g double, b double")).collect()}
    assert got["m", "ref"].is_referee and got["m", "ref"].cluster is None and got["m", "a0"].r == 200.0
    assert {got["m", p].cluster for p in kit if p[0] == "a"} == {0} and {got["m", p].cluster for p in kit if p[0] == "b"} == {1}
    assert got["one", "x"].cluster == 0 and not got["one", "x"].is_referee


def test_match_folder_and_results(spark, tmp_path):
    folder = tmp_path / "7"
    folder.mkdir()
    (folder / "7_match.json").write_text('{"pitch_length": 100, "pitch_width": 50, "home_team": {"id": 1}, "away_team": {"id": 2}, "players": [{"id": 9, "team_id": 1}]}')
    (folder / "7_tracking_extrapolated.jsonl").write_text('{"frame": 1, "timestamp": "00:00:01", "period": 1, "ball_data": {"x": 0, "y": 0, "z": 0, "is_detected": true}, "player_data": [{"x": 0, "y": 0, "player_id": 9, "is_detected": true}]}\n')
    for place in (tmp_path, folder):
        r = files.discover_match(spark, str(place), "skillcorner_7")[0].collect()
        assert [(x.match_id, x.team, x.x) for x in r] == [("skillcorner_7", "home", 0.5)]
    with pytest.raises(FileNotFoundError):
        files.discover_match(spark, str(tmp_path), 8)
    (tmp_path / "r.csv").write_text("run,f1\na,0.5\nb,NaN\n")
    assert {x.run: x.f1 for x in files.read_results(spark, str(tmp_path / "r.csv")).collect()} == {"a": 0.5, "b": None}
    (tmp_path / "r.json").write_text('{"n": 3}')
    assert files.read_results(spark, str(tmp_path / "r.json")).first().n == 3
    assert files.read_results(spark, str(tmp_path / "none.csv")) is None
