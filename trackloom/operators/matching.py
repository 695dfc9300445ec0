"""Matching of candidate events with annotated ones within a tolerance, and precision and recall."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which annotated types a candidate type stands for.
MAPPING = {"pass_candidate": ["PASS"], "turnover_candidate": ["BALL LOST", "BALL OUT"], "recovery_candidate": ["RECOVERY"]}
TOLERANCES = (0.2, 0.5, 1.0)


def tolerance_frames(seconds: float, fps: int = 25) -> int:
    return round(seconds * fps)


def tolerance_pairs(predicted: DataFrame, reference: DataFrame, tolerance: int, keys: list[str]) -> DataFrame:
    """keys, pred, ref, diff of frames at most tolerance apart: a range join as an equi-join on buckets of that width."""
    width = tolerance + 1
    a = predicted.select(*keys, F.col("frame").alias("pred")).withColumn("b", F.explode(F.array(*[F.floor(F.col("pred") / width) + d for d in (-1, 0, 1)])))
    b = reference.select(*keys, F.col("start_frame").alias("ref")).withColumn("b", F.floor(F.col("ref") / width))
    return a.join(b, [*keys, "b"]).withColumn("diff", F.abs(F.col("pred") - F.col("ref"))).where(F.col("diff") <= tolerance).select(*keys, "pred", "ref", "diff")


def match_greedy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one pairs by least (diff, pred, ref) first, for each value of the keys.

    What is taken depends on what was taken before, so a group's pairs go by in that order, sorted by Spark,
    and only the frames that were taken are kept meanwhile.
    """
    names = pairs.columns

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken = None, (set(), set())
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            keep = []
            for i, (key, pred, ref) in enumerate(zip(own, batch.column("pred").to_pylist(), batch.column("ref").to_pylist(), strict=True)):
                if key != group:
                    group, taken = key, (set(), set())
                if pred not in taken[0] and ref not in taken[1]:
                    taken[0].add(pred)
                    taken[1].add(ref)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int32()))

    return pairs.repartition(*keys).sortWithinPartitions(*keys, "diff", "pred", "ref").select(*names).mapInArrow(pick, pairs.schema)


def typed(predicted: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct frames of both by match_id and the candidate's event_type."""
    named = F.lit(None).cast("string")
    for kind, names in MAPPING.items():
        named = F.when(F.col("event_type").isin(*names), kind).otherwise(named)
    a = predicted.where(F.col("event_type").isin(*MAPPING)).select("match_id", "event_type", "frame").distinct()
    b = reference.withColumn("event_type", named).where("event_type IS NOT NULL").select("match_id", "event_type", "start_frame").distinct()
    return a, b


def _rates(df: DataFrame) -> DataFrame:
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("tp"), F.col("n_predicted")), safe(F.col("tp"), F.col("n_reference"))
    df = df.withColumns({"fp": F.col("n_predicted") - F.col("tp"), "fn": F.col("n_reference") - F.col("tp"), "precision": p, "recall": r})
    return df.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def precision_recall(predicted: DataFrame, reference: DataFrame, tolerances: tuple[float, ...] = TOLERANCES, fps: int = 25) -> DataFrame:
    """tolerance, event_type, counts and rates over all matches, with a row 'ALL' of the sums per tolerance."""
    a, b = typed(predicted, reference)
    keys = ["match_id", "event_type"]
    levels = F.array(*[F.struct(F.lit(float(t)).alias("tolerance"), F.lit(tolerance_frames(t, fps)).alias("frames")) for t in tolerances])
    # pairs are made once, at the widest tolerance, and dealt to those that they fit
    widest = tolerance_pairs(a, b, max(tolerance_frames(t, fps) for t in tolerances), keys)
    fitting = widest.withColumn("l", F.explode(F.filter(levels, lambda l: l["frames"] >= F.col("diff")))).select(*keys, "l.tolerance", "pred", "ref", "diff")
    tp = match_greedy(fitting, [*keys, "tolerance"]).groupBy("event_type", "tolerance").agg(F.count("*").alias("tp"), F.sum("diff").alias("error_frames"))
    sides = a.select("event_type", F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(b.select("event_type", F.lit(0).alias("p"), F.lit(1).alias("q")))
    n = sides.groupBy("event_type").agg(F.sum("p").alias("n_predicted"), F.sum("q").alias("n_reference")).withColumn("l", F.explode(levels))
    parts = n.select("event_type", "l.tolerance", "n_predicted", "n_reference").join(tp, ["event_type", "tolerance"], "left").fillna(0)
    summed = parts.rollup("tolerance", "event_type").agg(*[F.sum(c).alias(c) for c in ("n_predicted", "n_reference", "tp", "error_frames")]).where("tolerance IS NOT NULL")
    out = _rates(summed.withColumn("event_type", F.coalesce("event_type", F.lit("ALL"))))
    return out.withColumn("mean_error_seconds", F.when(F.col("tp") > 0, F.col("error_frames") / F.col("tp") / fps).otherwise(0.0)).drop("error_frames")


def change_metrics(predicted: DataFrame, reference: DataFrame, tolerance: float = 1.0, fps: int = 25) -> DataFrame:
    """All changes of possession but recoveries, pooled, against all annotated ones, per match."""
    a = predicted.where(F.col("event_type") != "recovery_candidate").select("match_id", "frame").distinct()
    b = reference.where(F.col("event_type").isin("PASS", "BALL LOST", "BALL OUT", "RECOVERY")).select("match_id", "start_frame").distinct()
    tp = match_greedy(tolerance_pairs(a, b, tolerance_frames(tolerance, fps), ["match_id"]), ["match_id"]).groupBy("match_id").agg(F.count("*").alias("tp"))
    n = a.groupBy("match_id").agg(F.count("*").alias("n_predicted")).join(b.groupBy("match_id").agg(F.count("*").alias("n_reference")), "match_id", "full")
    return _rates(n.join(tp, "match_id", "left").fillna(0))
