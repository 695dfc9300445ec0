import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import possession, repair
from trackloom.schema import TRACKING
from trackloom.streaming import causal


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    causal.rocks(spark)
    yield spark
    spark.conf.set(key, before)


def rows_of(frames=40):
    rnd = random.Random(5)
    out = []
    for match in ("m", "n"):
        for f in range(1, frames):
            for p in ("1", "2", "3"):
                seen = rnd.random() > 0.15
                out.append((match, f, f * 0.04, p, "home" if p < "3" else "away", round(rnd.random(), 3) if seen else None, round(rnd.random(), 3) if seen else None, 1.0, seen))
    return out


def drained(spark, rows, schema, build, tmp_path, late):
    """The rows of a stream over shuffled micro-batches, stopped halfway and started again from its checkpoint."""
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    frames = spark.createDataFrame(rows, schema)
    last = frames.agg(F.max("timestamp")).first()[0] + 1000  # a row far ahead lets the watermark pass the others
    end = frames.limit(1).withColumns({"match_id": F.lit("end"), "timestamp": F.lit(last)})
    rnd = random.Random(3)
    # each part holds rows of neighbouring frames in any order, some of them before those of the part before
    keyed = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, 10))
    parts = [spark.createDataFrame(keyed[i : i + 40], schema) for i in range(0, len(keyed), 40)] + [end, end]
    for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
        for part in half:
            part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 2).parquet(src)
        q = build(stream, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()
    return spark.read.parquet(out).where("match_id <> 'end'")


def key(df, *columns):
    return sorted(((*(r[c] for c in columns if c != "x"), None if "x" in columns and r.x is None else round(r.x, 9) if "x" in columns else 0) for r in df.collect()), key=str)


def test_filter_stream_equals_batch(rocks, tmp_path):
    rows = rows_of()
    got = drained(rocks, rows, TRACKING, lambda s, late: causal.filter_stream(s, late=late), tmp_path, "2 seconds")
    want = repair.causal_filter(rocks.createDataFrame(rows, TRACKING))
    assert key(got, "match_id", "player_id", "frame", "visible", "x") == key(want, "match_id", "player_id", "frame", "visible", "x")


def test_possession_stream_equals_batch(rocks, tmp_path):
    tracking = rocks.createDataFrame(rows_of(), TRACKING)
    scored = tracking.select("match_id", "frame", "timestamp").distinct().join(possession.possession_scores(tracking).select("match_id", "frame", "team", "player_id", "raw_score"), ["match_id", "frame"], "left")
    columns = ["match_id", "frame", "timestamp", "team", "player_id", "raw_score"]
    rows = [tuple(r) for r in scored.select(*columns).collect()]
    got = drained(rocks, rows, "match_id string, frame long, timestamp double, team string, player_id string, raw_score double", lambda s, late: causal.possession_stream(s, late=late), tmp_path, "2 seconds")
    want = possession.predict_possession(tracking)
    pick = lambda df: sorted(((r.match_id, r.frame, r.possessor_id, r.team, round(r.possession_score, 9), round(r.confidence, 9)) for r in df.collect()), key=str)
    assert pick(got) == pick(want) and len({r[2] for r in pick(got)}) > 2
