"""Checks of the canonical tables: counts of violations, and errors where a caller wants them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.schema import COLUMNS, TRACKING

KEY = ("match_id", "frame", "team", "player_id")
CONDITIONS = ("CLEAN", "SYNTHETIC-DEGRADED", "NOISE-MITIGATED")


def _long(counts: DataFrame) -> DataFrame:
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in counts.columns])).alias("r")).select("r.*")


def tracking_violations(tracking: DataFrame, coordinates_iff_visible: bool = True) -> DataFrame:
    """rule, violations: one pass over the rows, summed by key and then in all."""
    missing = F.col("x").isNull() | F.col("y").isNull()
    rules = {
        "null_match_id": F.col("match_id").isNull(),
        "confidence_range": F.coalesce(~F.col("confidence").between(0, 1), F.lit(True)),
        "team_vocabulary": F.coalesce(~F.col("team").isin("home", "away", "referee"), F.lit(True)),
    }
    if coordinates_iff_visible:
        rules |= {"visible_without_coordinates": F.col("visible") & missing, "coordinates_without_visible": ~F.col("visible") & (F.col("x").isNotNull() | F.col("y").isNotNull())}
    by_key = tracking.groupBy(*KEY).agg(F.count("*").alias("n"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return _long(by_key.agg(F.count_if(F.col("n") > 1).alias("duplicate_key"), *[F.sum(name).alias(name) for name in rules]))


def event_violations(events: DataFrame) -> DataFrame:
    """rule, violations of annotated events (see sources.metrica)."""
    ident = r"^(HOME|AWAY)_\d+$"
    far = F.lit(False)
    for c in ("start_x", "start_y", "end_x", "end_y"):
        far = far | F.coalesce(~F.col(c).between(-0.5, 1.5), F.lit(False))
    rules = {
        "team_vocabulary": F.coalesce(~F.col("team").isin("home", "away"), F.lit(True)),
        "order": F.coalesce(F.col("start_frame") > F.col("end_frame"), F.lit(False)),
        "half_coordinates": (F.col("start_x").isNull() != F.col("start_y").isNull()) | (F.col("end_x").isNull() != F.col("end_y").isNull()),
        "coordinate_range": far,
        "player_id": F.coalesce(~F.col("from_player_id").rlike(ident), F.lit(False)) | F.coalesce(~F.col("to_player_id").rlike(ident), F.lit(False)),
    }
    by_id = events.groupBy("match_id", "event_id").agg(F.count("*").alias("n"), *[F.count_if(r).alias(k) for k, r in rules.items()])
    by_match = by_id.groupBy("match_id").agg(F.count_if(F.col("n") > 1).alias("duplicate_event_id"), ((F.min("event_id") != 1) | (F.max("event_id") != F.count("*"))).cast("int").alias("event_id_sequence"), *[F.sum(k).alias(k) for k in rules])
    return _long(by_match.agg(*[F.sum(c).alias(c) for c in by_match.columns if c != "match_id"]))


def require(violations: DataFrame) -> None:
    """ValueError that names the broken rules; the table has a row per rule."""
    broken = {r.rule: r.violations for r in violations.where("violations > 0").collect()}
    if broken:
        raise ValueError(f"rules broken: {broken}")


def validate_tracking(tracking: DataFrame, coordinates_iff_visible: bool = True) -> None:
    missing = [c for c in COLUMNS if c not in tracking.columns]
    if missing:
        raise ValueError(f"tracking lacks {missing}")
    kinds = {f.name: f.dataType for f in tracking.schema.fields}
    wrong = [f.name for f in TRACKING.fields if f.name in ("x", "y", "confidence", "timestamp", "visible") and kinds[f.name] != f.dataType]
    if wrong:
        raise ValueError(f"columns of another type: {wrong}")
    require(tracking_violations(tracking, coordinates_iff_visible))


def summary_is_complete(summary: DataFrame) -> DataFrame:
    """run_id, complete: whether a run has each of the three conditions once."""
    return summary.groupBy("run_id").agg((F.array_sort(F.collect_list("condition")) == F.array_sort(F.array(*map(F.lit, CONDITIONS)))).alias("complete"))


def first_of(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
