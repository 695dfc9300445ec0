import json

import pytest
from pyspark.errors import PySparkException

from trackloom.operators import validate
from trackloom.schema import TRACKING
from trackloom.sources import files


def write(path, text):
    path.write_text(text)
    return str(path)


def wide(tmp_path, name, a, ball="0.5,0.5"):
    head = ",,,Home,,Home,,,\n,,,11,,1,,,\nPeriod,Frame,Time [s],Player11,,Player1,,Ball,\n"
    return write(tmp_path / name, head + f"1,1,0.04,{a},0.2,NaN,NaN,{ball}\n1,2,0.08,0.3,0.4,0.5,0.6,NaN,NaN\n")


def test_wide_csv(spark, tmp_path):
    t, ball = files.load_match(spark, wide(tmp_path, "h.csv", "0.1"), wide(tmp_path, "a.csv", "0.7"), "m")
    assert t.count() == 8 and t.where("visible").count() == 6 and ball.where("x IS NOT NULL").count() == 1
    r = t.where("team = 'home' AND player_id = '11' AND frame = 1").first()
    assert (r.x, r.y, r.confidence, r.timestamp) == (0.1, 0.2, 1.0, 0.04)
    with pytest.raises(ValueError, match="differ"):
        files.load_match(spark, wide(tmp_path, "h.csv", "0.1"), wide(tmp_path, "b.csv", "0.7", "0.9,0.5"), "m")


def test_annotated_events(spark, tmp_path):
    head = "Team,Type,Subtype,Period,Start Frame,Start Time [s],End Frame,End Time [s],From,To,Start X,Start Y,End X,End Y\n"
    path = write(tmp_path / "e.csv", head + "Home,PASS,,1,100,4.0,104,4.16,Player1,Player2,0.1,0.2,0.3,0.4\nAway,BALL LOST,INTERCEPTION,1,105,4.2,0,0,Player2,,0.5,0.5,NaN,NaN\n")
    e = files.read_annotated_events(spark, path, "m")
    assert tuple(e.columns) == files.EVENT_COLUMNS
    a, b = e.orderBy("event_id").collect()
    assert (a.event_id, a.from_player_id, a.to_player_id, a.end_frame) == (1, "HOME_1", "HOME_2", 104.0) and (b.end_frame, b.end_x, b.from_player_id, b.to_player_id) == (None, None, "AWAY_2", None)
    validate.require(validate.event_violations(e))
    with pytest.raises(ValueError, match="event_id"):
        validate.require(validate.event_violations(e.unionByName(e)))


def test_frame_lines(spark, tmp_path):
    match = {"home_team": {"id": 1}, "away_team": {"id": 2}, "pitch_length": 100, "pitch_width": 60, "players": [{"id": 7, "team_id": 1, "number": 9}, {"id": 8, "team_id": 2, "number": 4}]}
    line = {"frame": 5, "timestamp": "00:15.50", "period": 1, "ball_data": {"x": 0, "y": 0, "z": 1.5, "is_detected": True}, "player_data": [{"x": -50, "y": 30, "player_id": 7, "is_detected": True}, {"x": 60, "y": 36, "player_id": 8, "is_detected": False}]}
    m, t = write(tmp_path / "m.json", json.dumps(match, indent=1)), write(tmp_path / "t.jsonl", json.dumps(line) + "\n" + json.dumps(line | {"frame": 6, "timestamp": None}) + "\n")
    players, ball = files.read_frame_lines(spark, t, m, "m")
    got = {(r.frame, r.player_id): (r.team, r.x, r.y, r.visible, r.timestamp) for r in players.collect()}
    assert got[5, "7"] == ("home", 0.0, 1.0, True, 15.5) and got[6, "8"] == ("away", pytest.approx(1.1), pytest.approx(1.1), False, pytest.approx(0.6))
    assert ball.first().z == 1.5
    strange = write(tmp_path / "s.jsonl", json.dumps(line | {"player_data": [{"x": 0, "y": 0, "player_id": 99, "is_detected": True}]}))
    with pytest.raises(PySparkException, match="unknown player"):
        files.read_frame_lines(spark, strange, m, "m")[0].collect()


def test_round_trips(spark, tmp_path):
    t = spark.createDataFrame([("m", 1, 0.04, "1", "home", 0.1, float("nan"), 1.0, True)], TRACKING)
    for kind in ("csv", "parquet"):
        files.write_canonical(t, str(tmp_path / kind), kind)
        r = files.read_canonical(spark, str(tmp_path / kind), kind).first()
        assert (r.match_id, r.frame, r.x, r.y, r.visible) == ("m", 1, 0.1, None, True)
    files.write_results(t, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/json")).first().y is None
    assert files.read_config(spark, write(tmp_path / "c.json", '﻿{"a": 1}')) == {"a": 1}
