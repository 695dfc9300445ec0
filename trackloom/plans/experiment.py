"""Experiment plans: the grid of runs, conditions, evaluation of a condition, resumption, integrity."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import run_fields
from trackloom.operators import degrade, possession, quality, repair, tactics
from trackloom.schema import COLUMNS, FPS, FRAME, tracking_only
from trackloom.sources.matches import store
from trackloom.sources.shared import TASKS


def make_grid(spark: SparkSession, windows: list[tuple[float, float]], seeds: list[int], severities: list[str], fps: int = FPS) -> DataFrame:
    """A row per window, seed and severity, with its frames and run_id. The lists are the plan's own, a few rows."""
    w = spark.createDataFrame([(f"{a:g}_{b:g}s", round(a * fps) + 1, round(b * fps)) for a, b in windows], "window_label string, start_frame int, end_frame int")
    s = spark.createDataFrame([(x,) for x in seeds], "seed int")
    v = spark.createDataFrame([(x,) for x in severities], "severity string")
    return w.crossJoin(s).crossJoin(v).select(F.concat("window_label", F.lit("_seed"), F.col("seed").cast("string"), F.lit("_"), "severity").alias("run_id"), "*")


def match_runs(grid: DataFrame, tracking: DataFrame) -> DataFrame:
    """The grid's runs of each match whose frames reach into their window: match_id, run_id, the window clipped to the match's frames, n_frames, seed, severity."""
    frames = tracking.select(*FRAME).distinct()
    windows = F.broadcast(grid.select("window_label", "start_frame", "end_frame").distinct())  # a plan's own few windows
    own = frames.join(windows, F.col("frame").between(F.col("start_frame"), F.col("end_frame"))).groupBy("match_id", "window_label").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n_frames"))
    return own.join(grid, "window_label").select("match_id", "run_id", "window_label", "first_frame", "last_frame", "n_frames", "seed", "severity")


def run_config(base: dict, run: dict) -> dict:
    """A copy of base with the run's window, seed and severity; base stays as it is."""
    out = copy.deepcopy(base)
    out["run"] = dict(run)
    return out


def build_conditions(clean: DataFrame, severity: str, seed: int, method: str = "interpolation_moving_average") -> DataFrame:
    """The clean, degraded and mitigated tracking in one table with a condition, for one plan over all."""
    clean = tracking_only(clean)
    worse = degrade.degrade(clean, severity, seed).select(*COLUMNS)
    better = repair.mitigate(worse, method).select(*COLUMNS)
    named = lambda t, c: t.withColumn("condition", F.lit(c))
    return named(clean, "CLEAN").unionByName(named(worse, "SYNTHETIC-DEGRADED")).unionByName(named(better, "NOISE-MITIGATED"))


def subset(tracking: DataFrame, start_frame: int, end_frame: int) -> DataFrame:
    """Rows of the frames, both ends included; a filter that reaches the files."""
    if end_frame < start_frame:
        raise ValueError("end_frame before start_frame")
    return tracking.where(F.col("frame").between(start_frame, end_frame))


def evaluate(tracking: DataFrame, clean: DataFrame, top_k: int = 10) -> DataFrame:
    """Per match: quality, possession summary and stability of the advantage score against the clean tracking."""
    held, reference = possession.predict_possession(tracking), possession.predict_possession(clean)
    stable = quality.tactical_stability(tactics.tactical_scores(clean, reference), tactics.tactical_scores(tracking, held), reference, top_k)
    return quality.tracking_quality(tracking).join(possession.possession_summary(held), "match_id").join(stable, "match_id", "left")


def ablation(clean: DataFrame, severity: str, seed: int) -> DataFrame:
    """tracking_quality and coordinate errors for each mitigation method."""
    clean = tracking_only(clean)
    worse = degrade.degrade(clean, severity, seed, degrade.NAMES[:4]).select(*COLUMNS)
    out = None
    for method in repair.METHODS:
        own = repair.mitigate(worse, method).select(*COLUMNS)
        row = quality.tracking_quality(own).join(quality.coordinate_errors(clean, own), "match_id").withColumn("method", F.lit(method))
        out = row if out is None else out.unionByName(row)
    return out


def remaining(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Runs of the grid that have no result yet."""
    return grid.join(done.select("run_id").distinct(), "run_id", "left_anti")


def write_runs(results: DataFrame, folder: str) -> None:
    """A file of JSON per run and copy (run_id, copies, other columns): folder/shard=K/run_id=R/part-SHARD-COPY.json.

    Tasks write through Arrow's file systems, at a fraction of a Hadoop committer's cost a file; one that is tried again
    writes the same names and contents.
    """
    rows = results.select("run_id", "copies", F.to_json(F.struct(*[c for c in results.columns if c != "copies"])).alias("value"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("run_id"), F.lit(TASKS))).repartition(TASKS, "shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                own = f"{at.rstrip('/')}/shard={r['shard']}/run_id={quote(r['run_id'], safe='')}"
                system.create_dir(own, recursive=True)
                for i in range(r["copies"]):
                    with system.open_output_stream(f"{own}/part-{r['shard']}-{i}.json") as out:
                        out.write(r["value"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def result_files(spark: SparkSession, folder: str, pattern: str = "*.parquet", run_id: str = r"run_id=([^/]+)/") -> DataFrame:
    """run_id, path, size: the files below a folder as a table, with the run that their path names; no content is read.

    The driver lists the folder's own entries, tasks what is below them. Names that begin with _ or . are left out.
    """
    system, at = store(folder)
    at = at.rstrip("/")
    own = folder.rstrip("/")
    root = own.removesuffix(at) if own.endswith(at) else ""
    tops = [(f.path, f.is_file, f.size) for f in system.get_file_info(fs.FileSelector(at))]

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = store(folder)
        for batch in batches:
            for path, is_file, size in zip(*(batch.column(c).to_pylist() for c in ("path", "is_file", "size")), strict=True):
                found = [(path, size)] if is_file else [(f.path, f.size) for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file]
                shown = [(root + p, n) for p, n in found if fnmatch(p.rsplit("/", 1)[-1], pattern) and not any(x[:1] in ("_", ".") for x in p[len(at) + 1 :].split("/"))]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in shown], pa.string()), pa.array([n for _, n in shown], pa.int64())], ["path", "size"])

    listed = spark.createDataFrame(tops, "path string, is_file boolean, size long").repartition(max(1, min(TASKS, len(tops)))).mapInArrow(below, "path string, size long")
    named = listed.select("path", "size", F.regexp_extract("path", run_id, 1).alias("run_id"))
    return named.where("run_id <> ''").select("run_id", "path", "size")


def reconcile(report: DataFrame, files: DataFrame) -> DataFrame:
    """run_id, n_reported, n_files, status: a report (run_id) against result files (run_id, path), both ways.

    MISSING: reported without a file; SURPLUS: a file that no report names; DOUBLED: either twice; else OK. A null run takes no part.
    """
    count = lambda df, name: df.where("run_id IS NOT NULL").groupBy("run_id").agg(F.count("*").alias(name))
    both = count(report, "n_reported").join(count(files, "n_files"), "run_id", "full").fillna(0, ["n_reported", "n_files"])
    status = F.when(F.col("n_files") == 0, "MISSING").when(F.col("n_reported") == 0, "SURPLUS").when((F.col("n_files") > 1) | (F.col("n_reported") > 1), "DOUBLED").otherwise("OK")
    return both.withColumn("status", status)


def choose_canonical(artifacts: DataFrame) -> DataFrame:
    """One artifact per run: the least path_score, then the first path."""
    order = Window.partitionBy("run_id").orderBy("path_score", "path")
    return artifacts.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def integrity(grid: DataFrame, summaries: DataFrame) -> DataFrame:
    """run_id, status: SUCCESS, INVALID (a condition twice or unknown), INCOMPLETE or MISSING."""
    known = ["CLEAN", "SYNTHETIC-DEGRADED", "NOISE-MITIGATED"]
    own = summaries.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("condition").alias("k"), F.count_if(~F.col("condition").isin(*known)).alias("odd"))
    status = F.when(F.col("n").isNull(), "MISSING").when((F.col("odd") > 0) | (F.col("n") > F.col("k")), "INVALID").when(F.col("k") < 3, "INCOMPLETE").otherwise("SUCCESS")
    return grid.select("run_id").join(own, "run_id", "left").select("run_id", status.alias("status"))


def parse_runs(df: DataFrame, column: str = "run_id") -> DataFrame:
    return df.withColumns(run_fields(F.col(column)))


def duplicate_content(files: DataFrame) -> DataFrame:
    """digest, paths of files (path, content) that are equal; only digests are grouped."""
    own = files.select("path", F.sha2("content", 256).alias("digest"))
    return own.groupBy("digest").agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)


def fingerprint(*columns: str):
    """SHA-256 of a row's configuration as JSON in order of name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
