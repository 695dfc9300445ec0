"""Statistics over runs: descriptions, bootstrap intervals, paired effects, recovery, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.hashing import uniform


def describe(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return runs.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (1.96 * F.stddev_samp(v) / F.sqrt(F.count(v))).alias("ci_half"))


def grouped_summaries(runs: DataFrame, dimensions: list[str], value: str) -> DataFrame:
    """describe for each of the dimensions alone, in one pass: dimension, level and the measures."""
    long = runs.select(value, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions])).alias("g")).select(value, "g.*")
    return describe(long, ["dimension", "level"], value)


def bootstrap_interval(runs: DataFrame, by: str, order: str, value: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """by, low, high: the 2.5 and 97.5 percentiles of resampled means. Draws are hashes of group, resample and place.

    runs are summary rows, a few per group: each is met by its draws in an equi-join on its place.
    """
    group = Window.partitionBy(by)
    own = runs.select(by, F.col(value).alias("v"), (F.row_number().over(group.orderBy(order)) - 1).alias("i"), F.count("*").over(group).alias("n"))
    draws = own.select(by, "i", "n").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    draws = draws.select(by, "r", F.floor(uniform(seed, "boot", by, "r", "i") * F.col("n")).alias("i"))
    means = draws.join(own.select(by, "i", "v"), [by, "i"]).groupBy(by, "r").agg(F.avg("v").alias("m"))
    return means.groupBy(by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def pivot_conditions(runs: DataFrame, keys: list[str], value: str, conditions: tuple[str, ...]) -> DataFrame:
    return runs.groupBy(*keys).pivot("condition", list(conditions)).agg(F.first(value))


def paired_effect(runs: DataFrame, keys: list[str], value: str, a: str, b: str) -> DataFrame:
    """n, mean difference b - a, its sample deviation, Cohen's d (infinite if all differences are one nonzero number)."""
    wide = pivot_conditions(runs, keys, value, (a, b)).withColumn("d", F.col(f"`{b}`") - F.col(f"`{a}`"))
    out = wide.agg(F.count("d").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("std"))
    m, s = F.col("mean_difference"), F.col("std")
    return out.withColumn("cohens_d", F.when(s > 0, m / s).when(m == 0, 0.0).otherwise(F.signum(m) * float("inf")))


def paired_interval(runs: DataFrame, keys: list[str], value: str, a: str, b: str, resamples: int = 2000, seed: int = 1234) -> DataFrame:
    """paired_effect's row with the 2.5 and 97.5 percentiles of resampled pairs: of the mean difference (low, high) and of Cohen's d (d_low, d_high).

    A resample draws as many pairs as there are, by hashes of its number and of the draw's; pairs with a null
    are left out. Of a resample of equal differences d is 0 or infinite, as in paired_effect. runs are summary
    rows, one a run and condition: a draw meets its pair in an equi-join on its place.
    """
    wide = pivot_conditions(runs, keys, value, (a, b)).withColumn("d", F.col(f"`{b}`") - F.col(f"`{a}`")).where("d IS NOT NULL")
    whole = Window.partitionBy(F.lit(0))
    own = wide.select("d", (F.row_number().over(whole.orderBy(*keys)) - 1).alias("i"), F.count("*").over(whole).alias("n"))
    draws = own.select("i", "n").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    draws = draws.select("r", F.floor(uniform(seed, "pairs", "r", "i") * F.col("n")).alias("i"))
    m, s = F.avg("d"), F.stddev_samp("d")
    effects = draws.join(own.select("i", "d"), "i").groupBy("r").agg(m.alias("m"), F.when(s > 0, m / s).when(m == 0, 0.0).otherwise(F.signum(m) * float("inf")).alias("c"))
    at = lambda c, p: F.percentile(c, F.lit(p))
    ends = effects.agg(at("m", 0.025).alias("low"), at("m", 0.975).alias("high"), at("c", 0.025).alias("d_low"), at("c", 0.975).alias("d_high"))
    return paired_effect(runs, keys, value, a, b).join(ends)


def rises(levels: DataFrame, order: str, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """by, measure, n_levels, rises, first_fall: whether a measure never falls from one level to the next in their order.

    first_fall is the first level whose value is less than the one before; nulls are left out.
    """
    by = by or []
    long = levels.select(*by, F.col(order).alias("level"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("m")).select(*by, "level", "m.*").where("v IS NOT NULL")
    before = F.lag("v").over(Window.partitionBy(*by, "measure").orderBy("level"))
    falls = F.coalesce(F.col("v") < F.col("before"), F.lit(False))
    return long.withColumn("before", before).groupBy(*by, "measure").agg(F.count("*").alias("n_levels"), (F.count_if(falls) == 0).alias("rises"), F.min(F.when(falls, F.col("level"))).alias("first_fall"))


def recovery(runs: DataFrame, keys: list[str], value: str, clean: str, worse: str, better: str) -> DataFrame:
    """Ratio of means and mean of per-run ratios of what repair gains to what noise lost."""
    wide = pivot_conditions(runs, keys, value, (clean, worse, better)).select(*keys, F.col(f"`{clean}`").alias("c"), F.col(f"`{worse}`").alias("w"), F.col(f"`{better}`").alias("b"))
    wide = wide.withColumns({"drop": F.col("c") - F.col("w"), "gain": F.col("b") - F.col("w")})
    own = F.when(F.abs(F.col("drop")) > 1e-12, F.col("gain") / F.col("drop"))
    return wide.agg(F.avg("drop").alias("mean_drop"), F.avg("gain").alias("mean_gain"), (F.avg("gain") / F.nullif(F.avg("drop"), F.lit(0.0))).alias("recovery_of_means"), F.avg(own).alias("mean_recovery"))


def against_baseline(runs: DataFrame, keys: list[str], method: str, value: str, baseline: str = "none") -> DataFrame:
    """Per method: mean and 1.96 standard errors of the difference from the baseline's run with equal keys."""
    base = runs.where(F.col(method) == baseline).select(*keys, F.col(value).alias("base"))
    diff = runs.join(base, keys).withColumn("d", F.col(value) - F.col("base"))
    return diff.groupBy(method).agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), (1.96 * F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("ci_half"))


def verdict(effects: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """SUPPORTED, NOT SUPPORTED or PARTIALLY SUPPORTED by the sign of an interval."""
    v = F.when(F.col(low) > 0, "SUPPORTED").when(F.col(high) < 0, "NOT SUPPORTED").otherwise("PARTIALLY SUPPORTED")
    return effects.withColumn("verdict", v)


def top_rows(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def anomaly_rates(steps: DataFrame, by: list[str], threshold: float = 0.05) -> DataFrame:
    hit = F.col("step") > threshold
    return steps.where("step IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("anomalies"), (F.count_if(hit) / F.count("*")).alias("rate"))


def recovery_rows(runs: DataFrame, keys: list[str], value: str, clean: str, worse: str, better: str) -> DataFrame:
    """The keys and each run's recovery_fraction, (better - worse) / (clean - worse); null where nothing was lost."""
    wide = pivot_conditions(runs, keys, value, (clean, worse, better))
    lost = F.col(f"`{clean}`") - F.col(f"`{worse}`")
    return wide.select(*keys, F.when(F.abs(lost) > 1e-12, (F.col(f"`{better}`") - F.col(f"`{worse}`")) / lost).alias("recovery_fraction"))


def recovery_by(recovery: DataFrame, meta: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Mean recovery_fraction and number of runs by columns of the runs' meta table; runs without meta are left out."""
    return recovery.join(meta, keys).groupBy(*by).agg(F.count_distinct(*keys).alias("n_runs"), F.avg("recovery_fraction").alias("recovery_fraction"))


def around_anomalies(steps: DataFrame, keys: list[str], threshold: float = 0.05, reach: int = 10) -> DataFrame:
    """Rows of a track within reach frames of a step over the threshold, with n_anomalies, how many are that near."""
    near = Window.partitionBy(*keys).orderBy("frame").rangeBetween(-reach, reach)
    return steps.withColumn("n_anomalies", F.sum((F.col("step") > threshold).cast("long")).over(near)).where("n_anomalies > 0")
