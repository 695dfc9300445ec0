import json
import math
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackloom.functions import colours
from trackloom.functions.hashing import fnv_unit
from trackloom.operators import kits, passes, stats, tracks
from trackloom.plans import experiment
from trackloom.schema import TRACKING
from trackloom.sources import matches


def seen(spark, rows):
    """frame, player, team, x, y (and confidence) of match m."""
    return spark.createDataFrame([("m", f, f / 25.0, p, t, x, y, c[0] if c else 1.0, True) for f, p, t, x, y, *c in rows], TRACKING)


def test_chains_overlaps_and_gaps(spark):
    rows = [(f, "a", "home", 0.5, 0.5) for f in range(0, 10)]
    rows += [(f, "b", "home", 0.501, 0.5, 0.5) for f in range(8, 20)]  # overlaps a: a's rows stay
    rows += [(f, "c", "home", 0.502, 0.5) for f in range(31, 41)]  # 11 frames later: the same player, the gap stays open
    rows += [(f, "d", "home", 0.503, 0.5) for f in range(51, 60)]  # 10 frames later: filled
    rows += [(f, "line", "home", 0.5, 0.97) for f in range(60)] + [(3, "once", "home", 0.2, 0.2)]
    got = {(r.player_id, r.frame): r for r in tracks.bridge_tracks(seen(spark, rows), max_gap=10).collect()}
    assert {p for p, _ in got} == {"a"} and got["a", 8].x == 0.5 and got["a", 10].x == 0.501
    assert sorted(f for _, f in got) == [*range(20), *range(31, 60)]
    assert got["a", 45].x == pytest.approx(0.502 + 0.001 * 5 / 11) and got["a", 45].timestamp == 1.8


def test_squads_fill_every_place(spark):
    rows = [(f, f"p{k:02}", "home", 0.2, 0.05 + 0.075 * k, 0.5 + k / 100) for k in range(12) for f in range(5, 25)]
    rows += [(f, "few", "away", 0.7, 0.5) for f in range(7)] + [(f, "keeper", "away", 0.9, 0.5) for f in range(0, 30, 2)]
    out = tracks.squads(seen(spark, rows), total_frames=40).collect()
    assert len(out) == 2 * 11 * 40 and {r.frame for r in out} == set(range(40))
    at = {(r.player_id, r.frame): r for r in out}
    assert at["HOME_1", 10].y == pytest.approx(0.05 + 0.075 * 11) and at["HOME_11", 10].y == pytest.approx(0.05 + 0.075)  # the least sure of twelve is out
    assert at["HOME_1", 0].imputed and at["HOME_1", 0].x == pytest.approx(0.2) and at["HOME_1", 0].confidence == 0.75 and not at["HOME_1", 5].imputed
    assert at["HOME_2", 20].player_id == "HOME_2" and at["AWAY_1", 1].imputed and not at["AWAY_1", 2].imputed
    assert (at["AWAY_2", 39].x, at["AWAY_2", 39].y, at["AWAY_2", 39].confidence) == (pytest.approx(1 - 0.18), pytest.approx(0.8), 0.6)
    assert tracks.squads(seen(spark, [(1, "a", "home", 0.1, 0.1)]).limit(0)).count() == 0


def folder_of(tmp_path, n=3):
    for m in range(n):
        (tmp_path / f"{m}").mkdir()
        (tmp_path / f"{m}" / f"{m}_match.json").write_text(json.dumps({"pitch_length": 100, "pitch_width": 50, "home_team": {"id": 1}, "away_team": {"id": 2}, "players": [{"id": 10 + m, "team_id": 1}, {"id": 20, "team_id": 9}]}))
        lines = [{"frame": f, "timestamp": "00:00:%02d.5" % f if f else None, "player_data": [{"x": 10.0 * m, "y": -25.0, "player_id": 10 + m, "is_detected": True}, {"x": None, "y": None, "player_id": 20, "is_detected": False}]} for f in range(3)]
        (tmp_path / f"{m}" / f"{m}_tracking_extrapolated.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
        for side, x in (("home", "0.1"), ("away", "0.9")):
            (tmp_path / f"{m}" / f"{side}.csv").write_text(f",,,{side}\n,,,7\nPeriod,Frame,Time [s],Player7,,Player8,,Ball,\n1,1,0.04,{x},0.2,NaN,NaN,0.5,0.5\nnot a row\n1,2,0.08,{x},0.3,0.4\n")
    return str(tmp_path)


def test_many_matches_are_one_read(spark, tmp_path):
    matches.register(spark)
    folder = folder_of(tmp_path)
    wide = spark.read.format("match_files").option("prefix", "g").load(folder)
    assert wide.rdd.getNumPartitions() == 6 and wide.count() == 3 * 2 * 2 * 2
    at = {(r.match_id, r.team, r.player_id, r.frame): r for r in wide.collect()}
    assert (at["g1", "away", "7", 2].x, at["g1", "away", "7", 2].y, at["g1", "away", "7", 2].visible) == (0.9, 0.3, True)
    assert at["g0", "home", "8", 1].x is None and not at["g0", "home", "8", 2].visible
    lines = spark.read.format("match_files").option("kind", "lines")
    got = {(r.match_id, r.player_id, r.frame): (r.team, r.x, r.y, r.timestamp, r.visible) for r in lines.load(folder).collect()}
    assert got["2", "12", 2] == ("home", 0.7, 0.0, 2.5, True) and got["2", "20", 0] == ("referee", None, None, 0.0, False) and len(got) == 18
    plain = {(r.match_id, r.player_id, r.frame): (r.x, r.y) for r in lines.option("normalize_coords", "false").load(f"file://{folder}").collect()}
    assert plain["2", "12", 2] == (20.0, -25.0)
    (tmp_path / "0" / "0_match.json").unlink()
    with pytest.raises(PySparkException, match="no description"):
        lines.load(folder).collect()


def test_results_are_committed_whole_or_not_at_all(spark, tmp_path):
    matches.register(spark)
    place = str(tmp_path / "out")
    rows = spark.range(40).selectExpr("CAST(id % 4 AS STRING) AS match_id", "id AS frame", "id / 40D AS tas", "IF(id = 7, double('NaN'), 1D) AS other").repartition(3)
    sink = lambda df, mode: df.write.format("match_results").option("config", '{"seed": 72}').mode(mode).save(place)
    sink(rows, "append")
    back = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(place, header=True, inferSchema=True)
    assert sorted((str(r.match_id), r.frame, r.tas, r.other) for r in back.collect()) == sorted((r.match_id, r.frame, r.tas, None if math.isnan(r.other) else 1.0) for r in rows.collect())
    assert json.loads(open(f"{place}/config.json").read()) == {"rows": 40, "seed": 72}
    assert all(open(os.path.join(d, f)).read().endswith("</svg>\n") for d, _, names in os.walk(place) for f in names if f.endswith("svg"))
    before = sorted(os.path.join(d, f) for d, _, names in os.walk(place) for f in names)
    broken = rows.withColumn("tas", F.when(F.col("frame") == 33, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("tas")))
    for mode in ("append", "overwrite"):
        with pytest.raises(PySparkException):
            sink(broken, mode)
        assert before == sorted(os.path.join(d, f) for d, _, names in os.walk(place) for f in names)  # nothing lost, nothing left
        assert not [d for d in os.listdir(place) if d.startswith("_")]
    sink(rows.where("match_id = '1'"), "overwrite")
    assert sorted(d for d in os.listdir(place) if os.path.isdir(f"{place}/{d}")) == ["1"]
    with pytest.raises(PySparkException, match="lack"):
        sink(rows.drop("tas"), "append")


def test_fit_equals_plain_steps(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(passes.FEATURES))) * rng.uniform(0.1, 5, len(passes.FEATURES))
    x[:, 3] = 2.0
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    z = np.column_stack([(x - x.mean(0)) / np.where(x.std(0) < 1e-9, 1, x.std(0)), np.ones(400)])
    theta = np.zeros(z.shape[1])
    for _ in range(500):
        p = 1 / (1 + np.exp(-z @ theta))
        theta = theta - 0.08 * (z.T @ (p - y) / 400 + 0.05 * np.append(theta[:-1], 0))
    want = theta[:-1] / np.where(x.std(0) < 1e-9, 1, x.std(0))
    data = spark.createDataFrame([(*map(float, r), bool(v)) for r, v in zip(x, y, strict=True)] + [(None, *[1.0] * (len(passes.FEATURES) - 1), True)], [*passes.FEATURES, "hit"])
    got = passes.fit_pass_weights(data, "hit")
    assert np.allclose([got[f] for f in passes.FEATURES], want, atol=1e-6) and got[""] == pytest.approx(theta[-1] - want @ x.mean(0), abs=1e-6)
    part = passes.fit_pass_weights(data, "hit", sample=200)
    assert part == passes.fit_pass_weights(data.repartition(5), "hit", sample=200) or np.allclose([part[f] for f in part], [v for v in passes.fit_pass_weights(data.repartition(5), "hit", sample=200).values()])
    assert np.sign(part["distance"]) == 1 and passes.fit_pass_weights(data.where("NOT hit"), "hit") is None


def test_fnv_equals_hand(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h / (2**32 - 1)

    texts = ["", "a", "1:HOME_7:drop", "é:x", "foobar"]
    assert plain("foobar") * (2**32 - 1) == 0xBF9CF968  # a published value
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fnv_unit(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == [plain(t) for t in texts]


def test_colour_names_by_hand(spark):
    want = {(0, 0, 0): "Black", (255, 255, 255): "White", (150, 150, 150): "Grey", (114, 114, 114): "Black", (20, 20, 80): "Navy", (220, 30, 30): "Red", (80, 10, 10): "Maroon", (240, 140, 20): "Orange", (100, 50, 10): "Brown", (250, 230, 60): "Yellow", (255, 250, 200): "Cream"}
    want |= {(180, 255, 20): "Lime", (20, 120, 30): "Green", (20, 220, 60): "Bright Green", (20, 200, 200): "Turquoise", (10, 90, 90): "Teal", (20, 60, 200): "Royal Blue", (120, 160, 230): "Sky Blue", (150, 30, 200): "Purple", (230, 60, 160): "Pink", (41, 41, 41): "Black"}
    data = spark.createDataFrame([*want, (None, 1, 2)], "r int, g int, b int")
    got = {(x.r, x.g, x.b): x.n for x in data.select("r", "g", "b", colours.kit_name(F.col("r"), F.col("g"), F.col("b")).alias("n")).collect()}
    assert got == want | {(None, 1, 2): None}
    sides = spark.createDataFrame([("m", f"{c}{i}", *rgb, c, False) for c, rgb in enumerate(((220.0, 30.0, 30.0), (180.0, 20.0, 20.0))) for i in range(3)] + [("n", "x", 20.0, 60.0, 200.0, 0, False)], "match_id string, player_id string, r double, g double, b double, cluster int, is_referee boolean")
    assert {(r.match_id, r.cluster): r.name for r in kits.side_names(sides).collect()} == {("m", 0): "Light Red", ("m", 1): "Dark Red", ("n", 0): "Royal Blue"}


def test_order_of_levels_and_reports(spark):
    levels = spark.createDataFrame([("a", 0, 1.0, 5.0), ("a", 1, 2.0, 5.0), ("a", 2, 1.5, None), ("a", 3, 9.0, 6.0)], "by string, level int, up double, flat double")
    assert {(r.measure, r.n_levels, r.rises, r.first_fall) for r in stats.rises(levels, "level", ["up", "flat"]).collect()} == {("up", 4, False, 2), ("flat", 3, True, None)}
    report = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "run_id string")
    files = spark.createDataFrame([("a", "p"), ("b", "q"), ("d", "r"), (None, "s")], "run_id string, path string")
    assert {(r.run_id, r.n_reported, r.n_files, r.status) for r in experiment.reconcile(report, files).collect()} == {("a", 1, 1, "OK"), ("b", 2, 1, "DOUBLED"), ("c", 1, 0, "MISSING"), ("d", 0, 1, "SURPLUS")}


def test_interval_of_equal_differences(spark):
    runs = spark.createDataFrame([(k, c, k + d) for k in range(4) for c, d in (("A", 0.0), ("B", 2.0))] + [(9, "A", 1.0)], "run long, condition string, v double")
    r = stats.paired_interval(runs, ["run"], "v", "A", "B", 50).first()
    assert (r.n, r.mean_difference, r.low, r.high, r.cohens_d, r.d_low) == (4, 2.0, 2.0, 2.0, math.inf, math.inf)
