"""What only shows on larger tables: places on a radius, what the plans sort, whole fits, files of many runs."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import graph, passes, possession, quality
from trackloom.plans import experiment
from trackloom.queries_repair import QUERIES
from trackloom.schema import TRACKING
from trackloom.sources import matches
from trackloom.sources.adapter import tracking

SMALL = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([("m", 1, 0.04, p, t, x, y, 1.0, True) for p, t, x, y in rows], TRACKING)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_obstruction_on_the_radius_is_that_of_the_sql(spark):
    """The opponent is 0.035 off the line, up to the last digit: the SQL's order of differences leaves it out."""
    t = frame(spark, [("1", "away", 0.716, 0.87), ("3", "away", 0.772, 0.78), ("4", "home", 0.751, 0.88)])
    got = {(r.source_player_id, r.target_player_id): r.obstruction for r in passes.pass_candidates(t).collect()}
    assert got[("1", "3")] == 0


def test_pairs_of_frames_are_never_sorted(spark):
    """An aggregation of pairs with a struct's minimum goes by sort, so a task held all pairs of its frames."""
    t = tracking(spark, SMALL)
    for df in (graph.graph_nodes(t), possession.possession_scores(t), possession.memoryless(t), passes.pass_candidates(t, possession.memoryless(t))):
        assert "SortAggregate" not in executed(df)
    assert "WindowGroupLimit" not in executed(possession.memoryless(t))


def test_scores_without_neighbours_or_places(spark):
    """One player alone, equal places, a team that is no side's, and a frame without anyone visible."""
    alone = possession.possession_scores(frame(spark, [("1", "away", 0.7, 0.8)]), dynamic=False).first()
    assert alone.raw_score == 0.0
    same = possession.possession_scores(frame(spark, [(p, t, 0.1, 0.3) for t in ("away", "home") for p in "123"]), dynamic=False).collect()
    assert {r.team_compactness for r in same} == {0.0} and {r.local_density for r in same} == {0.0}
    best = possession.memoryless(frame(spark, [(p, t, 0.1, 0.3) for t in ("home", "away") for p in "21"])).collect()
    assert [(r.team, r.player_id) for r in best] == [("away", "1")]
    hidden = spark.createDataFrame([("m", 1, 0.04, "1", "home", None, None, 0.0, False)], TRACKING)
    assert possession.memoryless(hidden).count() == 0 and graph.graph_nodes(hidden).count() == 0


def test_fit_takes_all_rows_beyond_what_the_driver_holds(spark):
    rows = passes.pass_candidates(tracking(spark, SMALL)).withColumn("hit", (F.col("distance") * 7 + F.col("angle") > 2).cast("int")).persist()
    here, there = passes.fit_pass_weights(rows, "hit", steps=5), passes.fit_pass_weights(rows, "hit", steps=5, local=10)
    rows.unpersist()
    assert there == pytest.approx(here, rel=1e-9)


def test_runs_are_written_by_many_tasks_and_listed(spark, tmp_path):
    runs = spark.createDataFrame([(f"run{i}", i, 1 + i % 2) for i in range(40)], "run_id string, rows int, copies int").coalesce(1)
    experiment.write_runs(runs, f"file://{tmp_path}/runs")
    (tmp_path / "runs" / "_temporary").mkdir()
    (tmp_path / "runs" / "_temporary" / "part-0.json").write_text("")
    found = experiment.result_files(spark, f"file://{tmp_path}/runs", "*.json").groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in found} == {f"run{i}": 1 + i % 2 for i in range(40)}
    assert len({p.name.split("-")[1] for p in (tmp_path / "runs").rglob("part-*.json")}) > 8


def test_mitigation_methods_has_a_plan_of_stored_rows(spark):
    """One plan with the noise in it for each way and measure took the driver's memory."""
    plan = QUERIES["mitigation_methods"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.splitlines()) < 150


def test_clean_rows_are_neither_multiplied_nor_broadcast(spark):
    """Spark took the clean rows for as small as their Parquet file, though they were dealt to eight ways: all went through the driver."""
    for name in ("mitigation_methods", "coord_errors", "degradation_stats"):
        plan = executed(QUERIES[name](spark, SMALL)).split("== Initial Plan ==")[0]
        joins = [line for line in plan.splitlines() if "Join [" in line and "frame" in line]
        assert len(joins) == 1 and "SortMergeJoin" in joins[0] and "explode" not in plan


def test_errors_by_a_column_are_those_of_each_of_its_tables(spark):
    """One of the tables has no rows of the second match, and a player in another place."""
    rows = lambda m, dx: [(m, f, f * 0.04, p, "home", 0.1 * f + dx, 0.2, 1.0, True) for f in (1, 2, 3) for p in "12"]
    clean = spark.createDataFrame(rows("a", 0.0) + rows("b", 0.0), TRACKING)
    tests = {"u": spark.createDataFrame(rows("a", 0.0) + [(*r[:5], None, None, 0.0, False) if r[1] == 2 else r for r in rows("b", 0.3)], TRACKING), "v": spark.createDataFrame(rows("a", 0.1), TRACKING)}
    every = tests["u"].withColumn("k", F.lit("u")).unionByName(tests["v"].withColumn("k", F.lit("v")))
    got = sorted(tuple(r) for r in quality.coordinate_errors(clean, every, by=("k",)).collect())
    assert got == sorted((k, *r) for k, t in tests.items() for r in quality.coordinate_errors(clean, t).collect())
    assert got[2][:5] == ("v", "a", 0.0, 0.1, 0.1) and got[3][:4] == ("v", "b", 100.0, 0.0)


def test_rows_of_a_frame_are_sorted_once_and_never_collected(spark):
    """Frames collected into arrays and joined with their numbers had every row sorted four times, in both tasks of the shuffle."""
    t = tracking(spark, SMALL)
    for df, most in ((possession.memoryless(t), 2), (possession.possession_scores(t, dynamic=False, index=False), 2), (graph.graph_nodes(t), 2), (passes.pass_candidates(t, possession.memoryless(t).select("match_id", "frame", "team", "player_id")), 4)):
        plan = executed(df).split("== Initial Plan ==")[0]
        assert "ObjectHashAggregate" not in plan and "SortMergeJoin" not in plan
        assert plan.count("Sort [") <= most


def test_frames_that_lie_across_batches_are_whole(spark):
    t = tracking(spark, SMALL)
    held = possession.memoryless(t).select("match_id", "frame", "team", "player_id")
    dfs = lambda: (possession.memoryless(t), possession.possession_scores(t), graph.graph_nodes(t), passes.pass_candidates(t, held), possession.predict_possession(t))
    want = [sorted(map(str, df.collect())) for df in dfs()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert [sorted(map(str, df.collect())) for df in dfs()] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_grid_deals_rows_to_cells_after_drawing_and_not_to_methods(spark):
    """Each cell drew and sorted its own rows, and each method had its own rows of candidates."""
    t = tracking(spark, SMALL)
    held = possession.memoryless(t).select("match_id", "frame", "team", "player_id")
    plan = passes.ranking_grid(t, held, ["jitter", "dropout"], ["mild", "severe"], 72)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 5  # two for either coordinate, one for the order of dropping
    below = plan[plan.index("md5") :]
    assert "explode" not in below[: below.index("Relation")] and "row_number() windowspecdefinition(method" not in plan


def test_rankings_of_states_without_common_targets(spark):
    schema = "match_id string, frame long, team string, source_player_id string, target_player_id string, rank int, decision_score double"
    clean = spark.createDataFrame([("m", 1, "home", "1", t, r, 0.0) for t, r in (("2", 1), ("3", 2), ("4", 3))] + [("m", 2, "home", "1", "2", 1, 0.0), ("m", 3, "home", "1", "2", 1, 0.0)], schema)
    other = spark.createDataFrame([("m", 1, "home", "1", t, r, s) for t, r, s in (("4", 1, 3.0), ("3", 2, 2.0), ("2", 3, 1.0))] + [("m", 2, "home", "1", "5", 1, 1.0)], schema)
    got = {r.frame: r for r in passes.compare_rankings(clean, other, 1).collect()}
    assert (got[1].n_common, got[1].spearman, got[1].kendall, got[1].top1_flip, got[1].top_k_retained) == (3, -1.0, -1.0, True, False)
    assert got[1].displacement == pytest.approx(4 / 3) and got[1].score_variance == pytest.approx(2 / 3)
    for f in (2, 3):
        assert (got[f].n_common, got[f].spearman, got[f].displacement, got[f].score_variance, got[f].top1_flip) == (0, None, None, None, True)


def test_many_small_files_share_partitions(spark, tmp_path):
    """A task per file of some lines: thousands of tasks that each started a reader."""
    matches.register(spark)
    for m in range(600):
        (tmp_path / f"m{m:03}").mkdir()
        (tmp_path / f"m{m:03}" / "home.csv").write_text(f"\n\nPeriod,Frame,Time [s],Player{m},\n1,1,0.04,0.1,0.2\n")
    read = spark.read.format("match_files").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 300
    assert {(r.match_id, r.player_id) for r in read.collect()} == {(f"m{m:03}", str(m)) for m in range(600)}
    assert [len(p.files) for p in matches.dealt([matches.OneFile("a", "a", size=20 << 20)] * 1025)] == [1] * 1025
