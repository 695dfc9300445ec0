import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions import scalars
from trackloom.operators import degrade, graph, matching, passes, pitch, possession, repair, serve, stats, tactics, validate
from trackloom.plans import experiment
from trackloom.schema import TRACKING, tracking_only

F11 = [("HOME_1", "home", 0.20, 0.50), ("HOME_2", "home", 0.50, 0.50), ("HOME_3", "home", 0.32, 0.70), ("AWAY_1", "away", 0.42, 0.50), ("AWAY_2", "away", 0.75, 0.20)]
F12 = [("HOME_1", "home", 0.1, 0.5), ("HOME_2", "home", 0.2, 0.4), ("HOME_3", "home", 0.3, 0.6), ("AWAY_1", "away", 0.8, 0.5), ("AWAY_2", "away", 0.9, 0.2)]


def table(spark, rows, frame=10):
    return spark.createDataFrame([("m", frame, frame * 0.04, p, t, x, y, 1.0, True) for p, t, x, y in rows], TRACKING)


def track(spark, values, player="1", team="home"):
    """values: x by frame from 1, None where not visible."""
    return spark.createDataFrame([("m", i, i * 0.04, player, team, x, None if x is None else 0.5, 0.0 if x is None else 1.0, x is not None) for i, x in enumerate(values, 1)], TRACKING)


def xs(df):
    return [r.x for r in df.orderBy("player_id", "frame").collect()]


def test_three_four_five(spark):
    pairs = graph.frame_pairs(table(spark, [("a", "home", 0.0, 0.0), ("b", "away", 3.0, 4.0)])).collect()
    assert sorted((r.src_id, r.dst_id, r.dist, r.same_team) for r in pairs) == [("a", "b", 5.0, False), ("b", "a", 5.0, False)]


def test_pass_features(spark):
    got = {r.target_player_id: r for r in passes.pass_candidates(table(spark, F11), config={"max_distance": 0.35}).where("source_player_id = 'HOME_1'").collect()}
    assert set(got) == {"HOME_2", "HOME_3"}
    r = got["HOME_2"]
    assert (r.distance, r.forward_progress, r.angle) == pytest.approx((0.30, 0.30, 0.0)) and r.obstruction == 1


def test_tactical_snapshot(spark):
    t = table(spark, F12)
    held = spark.createDataFrame([("m", 10, 0.4, "HOME_1", "home", 1.0, 1.0)], possession.TIMELINE)
    r = tactics.tactical_features(t, held).first()
    assert (r.home_centroid_x, r.home_centroid_y, r.home_width, r.home_length, r.home_compactness_area) == pytest.approx((0.2, 0.5, 0.2, 0.2, 0.04))
    assert (r.away_centroid_x, r.away_centroid_y, r.possessor_pressure, r.possessor_support, r.forward_options) == pytest.approx((0.85, 0.35, 0.7, 1, 2))
    assert tactics.tactical_features(t, held, False).first().forward_options == 0
    assert tactics.tactical_features(t, held, None).first().forward_options is None
    none = spark.createDataFrame([("m", 10, 0.4, None, None, 0.0, 0.0)], possession.TIMELINE)
    assert tactics.tactical_scores(t, none).first().tas == 0.0


def test_interpolation(spark):
    got = repair.interpolate(track(spark, [None, 0.1, None, None, 0.4, None]), max_gap=2)
    assert xs(got)[1:5] == pytest.approx([0.1, 0.2, 0.3, 0.4]) and [r.imputed for r in got.orderBy("frame").collect()] == [False, False, True, True, False, False]
    assert xs(repair.interpolate(track(spark, [0.1, None, None, 0.4]), max_gap=1)) == [0.1, None, None, 0.4]
    decay = repair.interpolate(track(spark, [0.0, None, None, None, 0.4]), confidence_decay=True)
    assert [r.confidence for r in decay.orderBy("frame").collect()] == pytest.approx([1, 0.375, 0.25, 0.375, 1])
    with pytest.raises(ValueError):
        repair.interpolate(track(spark, [0.1]), 0)


def test_smoothing_keeps_gaps_and_lines(spark):
    line = [0.1 + 0.01 * i for i in range(9)]
    assert xs(repair.savitzky_golay(track(spark, line))) == pytest.approx(line)
    square = [0.01 * i * i for i in range(12)]
    assert xs(repair.savitzky_golay(track(spark, square))) == pytest.approx(square)
    assert xs(repair.moving_average(track(spark, [0.0, 0.3, None, 0.6, 0.0]))) == [0.0, 0.3, None, 0.6, 0.0]
    with pytest.raises(ValueError):
        repair.savitzky_golay(track(spark, line), 4)


def test_leakage_and_order(spark):
    rnd = random.Random(1)
    rows = [("m", f, f * 0.04, f"{p}", "home" if p < 3 else "away", rnd.random(), rnd.random(), 1.0, True) for f in range(1, 15) for p in range(6)]
    t = spark.createDataFrame(rows, TRACKING)
    rnd.shuffle(rows)
    other = spark.createDataFrame(rows, TRACKING).withColumn("ball_x", F.rand()).repartition(5)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(possession.predict_possession(t)) == key(possession.predict_possession(other))
    calm = possession.possession_summary(possession.predict_possession(t, persistence_window=50)).first().switches
    assert calm < possession.possession_summary(possession.predict_possession(t, persistence_window=0, switch_margin=0.0)).first().switches
    assert {r.possessor_id for r in possession.predict_possession(t, min_score_threshold=2.0).collect()} == {None}
    with pytest.raises(ValueError):
        tracking_only(t.drop("visible"))


def test_events(spark):
    rows = [("m", i, i * 0.04, p, t, 1.0, 1.0) for i, (p, t) in enumerate([("a", "home"), ("b", "home"), ("c", "away"), ("a", "home"), (None, None)], 1)]
    got = [(r.frame, r.event_type) for r in possession.infer_events(spark.createDataFrame(rows, possession.TIMELINE)).orderBy("frame", "event_type").collect()]
    assert got == [(2, "pass_candidate"), (3, "turnover_candidate"), (4, "recovery_candidate"), (4, "turnover_candidate"), (5, "possession_change")]
    assert possession.infer_events(spark.createDataFrame(rows[:1], possession.TIMELINE)).count() == 0


def test_matching_counts(spark):
    ref = spark.createDataFrame([("m", i, f, t) for i, (f, t) in enumerate([(10, "PASS"), (20, "BALL LOST"), (30, "RECOVERY"), (40, "CHALLENGE")])], "match_id string, event_id long, start_frame long, event_type string")
    pred = spark.createDataFrame([("m", f, t) for f, t in [(11, "pass_candidate"), (26, "turnover_candidate"), (30, "recovery_candidate"), (11, "pass_candidate")]], "match_id string, frame long, event_type string")
    got = {(r.tolerance, r.event_type): r for r in matching.precision_recall(pred, ref, (0.2, 0.5)).collect()}
    assert [(got[t, "ALL"].tp, got[t, "ALL"].fp, got[t, "ALL"].fn) for t in (0.2, 0.5)] == [(2, 1, 1), (3, 0, 0)]
    none = matching.precision_recall(pred.limit(0), ref, (0.2,)).where("event_type = 'ALL'").first()
    assert (none.tp, none.fn, none.f1) == (0, 3, 0.0)


def test_degradation(spark):
    rnd = random.Random(3)
    t = spark.createDataFrame([("m", f, f * 0.04, f"{p}", "home" if p < 2 else "away", rnd.random(), rnd.random(), 1.0, True) for f in range(50) for p in range(4)], TRACKING)
    rows = lambda df: sorted(tuple(r) for r in df.select(*TRACKING.fieldNames()).collect())
    assert rows(degrade.degrade(t, "clean")) == rows(t)
    a = rows(degrade.degrade(t, "severe", 1))
    assert a == rows(degrade.degrade(t.repartition(7), "severe", 1)) != rows(degrade.degrade(t, "severe", 2))
    worse = degrade.degrade(t, "severe", 1)
    assert worse.count() == 200 and worse.groupBy("frame", "team", "player_id").count().where("count > 1").count() == 0
    assert worse.where("visible AND x IS NULL OR NOT visible AND x IS NOT NULL").count() == 0
    cut = degrade.fragmentation(t, 1.0, 2)
    assert {r.player_id for r in cut.collect()} == {f"{p}_frag_{k}" for p in range(4) for k in range(3)}
    swapped = degrade.identity_switch(t, 1.0, 5, 10)
    assert sorted(r.player_id for r in swapped.collect()) == sorted(r.player_id for r in t.collect()) and rows(swapped) != rows(t)
    with pytest.raises(ValueError):
        degrade.degrade(t, enabled=["nothing"])
    drop = degrade.perturb_snapshot(table(spark, F11 * 1), "dropout", "severe", 3)
    assert drop.count() == 4


def test_validation(spark):
    good = table(spark, F11)
    validate.validate_tracking(good)
    bad = good.withColumn("confidence", F.lit(2.0)).unionByName(good)
    with pytest.raises(ValueError, match="confidence_range"):
        validate.validate_tracking(bad)
    with pytest.raises(ValueError, match="lacks"):
        validate.validate_tracking(good.drop("x"))


def test_scalars(spark):
    rows = [("00:15.50", 15.5), ("1:00:01", 3601.0), ("7", 7.0), ("", None), (None, None), ("x:1", None), ("1:2:3:4", None)]
    got = spark.createDataFrame(rows, "t string, want double").withColumn("got", scalars.seconds(F.col("t")))
    assert all(r.got == r.want for r in got.collect())
    names = spark.createDataFrame([("#ffffff",), ("#000000",), ("#ff0000",), ("#00ff00",), ("#zzz",)], "c string").select(scalars.colour_name(F.col("c")).alias("n"))
    assert [r.n for r in names.collect()] == ["white", "black", "red", "green", "unknown"]
    run = spark.createDataFrame([("0_60s_seed72_moderate",), ("odd",)], "run_id string")
    assert [tuple(r)[1:] for r in experiment.parse_runs(run).collect()] == [("0_60s", 72, "moderate"), (None, None, None)]


def test_homography_and_boxes(spark):
    h = pitch.four_point_homography([(0, 0), (2, 0), (2, 1), (0, 1)], [(0, 0), (1, 0), (1, 1), (0, 1)])
    x, y, on = pitch.project(F.col("u"), F.col("v"), h)
    got = spark.createDataFrame([(1.0, 0.5), (3.0, 0.5)], "u double, v double").select(x.alias("x"), y.alias("y"), on.alias("on")).collect()
    assert [(r.x, r.y, r.on) for r in got] == [pytest.approx((0.5, 0.5, True)), pytest.approx((1.5, 0.5, False))]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 20.0, 0.9), (1, 1.0, 1.0, 11.0, 19.0, 0.8), (1, 30.0, 0.0, 40.0, 20.0, 0.7)], "frame int, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r.x1 for r in pitch.suppress_duplicates(boxes, ["frame"]).collect()) == [0.0, 30.0]


def test_statistics(spark):
    runs = spark.createDataFrame([("r1", "A", 1.0), ("r1", "B", 2.0), ("r2", "A", 2.0), ("r2", "B", 4.0)], "run_id string, condition string, v double")
    r = stats.paired_effect(runs, ["run_id"], "v", "A", "B").first()
    assert (r.n, r.mean_difference, r.cohens_d) == pytest.approx((2, 1.5, 1.5 / math.sqrt(0.5)))
    same = runs.withColumn("v", F.when(F.col("condition") == "A", 1.0).otherwise(2.0))
    assert stats.paired_effect(same, ["run_id"], "v", "A", "B").first().cohens_d == float("inf")
    b = stats.bootstrap_interval(runs, "condition", "run_id", "v", 200).where("condition = 'A'").first()
    assert 1.0 <= b.low <= b.high <= 2.0
    grid = experiment.make_grid(spark, [(0, 60)], [1, 2], ["mild"])
    done = spark.createDataFrame([(f"0_60s_seed1_mild", c) for c in validate.CONDITIONS], "run_id string, condition string")
    assert {r.run_id: r.status for r in experiment.integrity(grid, done).collect()} == {"0_60s_seed1_mild": "SUCCESS", "0_60s_seed2_mild": "MISSING"}
    assert [r.run_id for r in experiment.remaining(grid, done).collect()] == ["0_60s_seed2_mild"]


def test_plans(spark):
    rnd = random.Random(5)
    t = spark.createDataFrame([("m", f, f * 0.04, f"{p}", "home" if p < 2 else "away", 0.2 + 0.1 * p + 0.002 * f, rnd.random(), 1.0, True) for f in range(1, 20) for p in range(4)], TRACKING)
    both = experiment.build_conditions(t, "mild", 3)
    assert {r.condition: r["count"] for r in both.groupBy("condition").count().collect()} == dict.fromkeys(validate.CONDITIONS, 76)
    r = experiment.evaluate(t, t).first()
    assert r.mean_error == 0.0 and r.top_k_agreement == 1.0 and r.total_frames == 19
    assert experiment.ablation(t, "moderate", 1).count() == len(repair.METHODS)


def test_serving(spark):
    t = table(spark, F11).withColumn("jersey_color", F.when(F.col("team") == "home", "#FF0000"))
    got = {r.team: (r.colour, r.name) for r in serve.team_colours(t, {"home": "#0000ff", "away": "#0000ff"}).collect()}
    assert got == {"home": ("#ff0000", "red"), "away": ("#0000ff", "blue")}
    assert serve.nearest_frame(t, "m", 30).count() == 5 and serve.nearest_frame(t, "m", 90).count() == 0
    assert len(serve.frame_map(t).first().players) == 5
    assert [r.label for r in passes.select_scenarios(spark.createDataFrame([(1, 5.0, 9.0), (2, 4.0, 8.0)], "state_id int, a double, b double"), {"p": "a", "q": "b"}).orderBy("label").collect()] == ["p", "q"]
    dense = pitch.densify(track(spark, [None, 0.2, None, 0.4]), 1, 5)
    assert xs(dense) == pytest.approx([0.2, 0.2, 0.3, 0.4, 0.4])
