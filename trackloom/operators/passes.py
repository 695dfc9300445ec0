"""Hypothetical passes: candidates, features, completion probability, ranking and its stability."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import clip, sigmoid
from trackloom.operators.degrade import noise_cell, perturb_cells
from trackloom.operators.graph import Players, by_frame, codes, least, runs_of, visible, whole
from trackloom.schema import FRAME, tracking_only

FEATURES = ("distance", "forward_progress", "angle", "source_pressure", "target_pressure", "target_space", "target_support", "obstruction", "team_width", "team_length")
CANDIDATES = "match_id string, frame long, team string, source_player_id string, target_player_id string, " + ", ".join(f"{f} {'long' if f in ('target_support', 'obstruction') else 'double'}" for f in FEATURES)
# The candidates' bounds and the ranking's weights.
CONFIG = dict(min_distance=0.02, max_distance=0.70, support_radius=0.15, obstruction_radius=0.035)
WEIGHTS = dict(probability=0.55, space=0.15, support=0.10, pressure=0.10, distance=0.05, forward=0.20)
PROFILES = {"probability_heavy": dict(probability=0.80, space=0.05, forward=0.10), "balanced": {}, "tactical_heavy": dict(probability=0.30, space=0.25, forward=0.35)}


def pass_candidates(tracking: DataFrame, sources: DataFrame | None = None, home_attacks_x1: bool = True, config: dict | None = None) -> DataFrame:
    """A row per frame, source and teammate in range, with the ten features.

    sources: match_id, frame, team, player_id, to keep only these; else every visible player.
    """
    c = CONFIG | (config or {})
    rows = visible(tracking_only(tracking)).select(*FRAME, "team", "player_id", "x", "y")
    some = sources is not None
    if some:
        # a source is a row beside its player's: both are dealt to their frame at once, and nothing is joined
        none = F.lit(None).cast("double")
        marks = sources.select(*FRAME, "team", "player_id", none.alias("x"), none.alias("y"), F.lit(True).alias("mark"))
        rows = rows.withColumn("mark", F.lit(False)).unionByName(marks).where("match_id IS NOT NULL AND frame IS NOT NULL")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = np.ones(batch.num_rows, bool)
            if some:
                mark, start = batch.column("mark").to_numpy(zero_copy_only=False), runs_of(batch, (*FRAME, "team", "player_id"))
                asked = np.repeat(np.logical_or.reduceat(mark, start), np.diff(start, append=len(mark)))[~mark]
                batch = batch.filter(pa.array(~mark))
            t = Players(batch)
            home = t.column["team"].fill_null("").to_pylist()
            way = np.where((np.array([x == "home" for x in home], bool)) == home_attacks_x1, 1.0, -1.0)
            asked = np.flatnonzero(asked)
            for places, start, other in t.beside(asked):
                yield from moves(t, asked[places], start, other, way)

    def moves(t: Players, sources: np.ndarray, start: np.ndarray, other: np.ndarray, way: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The candidates of some sources, by their pairs with all players of their frames."""
        runs = np.diff(start, append=len(other))
        one = np.repeat(sources, runs)
        dist, (mate, foe) = t.apart(one, other), t.sides(one, other)
        pressure = least(dist, foe, start)
        spans = {n: -least(-v[other], mate, start) - least(v[other], mate, start) for n, v in (("width", t.y), ("length", t.x))}
        found = np.flatnonzero(mate & (dist >= c["min_distance"]) & (dist <= c["max_distance"]))
        run = np.repeat(np.arange(len(sources)), runs)[found]
        for part, begin, q in t.beside(other[found]):
            own, r = found[part], run[part]
            s, m = one[own], other[own]
            lx, ly = t.x[m] - t.x[s], t.y[m] - t.y[s]
            k = np.repeat(np.arange(len(own)), np.diff(begin, append=len(q)))
            near, (mates, foes) = t.apart(m[k], q), t.sides(m[k], q)
            # a target's support leaves the source out
            support = np.add.reduceat(mates & (t.id[q] != t.id[s[k]]) & (near > 0) & (near <= c["support_radius"]), begin, dtype=np.int64)
            size = lx * lx + ly * ly
            with np.errstate(invalid="ignore"):
                ax, ay = t.x[q] - t.x[s[k]], t.y[q] - t.y[s[k]]
                at = np.clip((ax * lx[k] + ay * ly[k]) / np.where(size == 0, 1.0, size)[k], 0.0, 1.0)
                # differences one after another, as the SQL takes them: the grid of the places has many that lie on the radius
                bx, by = ax - at * lx[k], ay - at * ly[k]
                blocks = foes & (np.sqrt(bx * bx + by * by) <= c["obstruction_radius"]) & (at > 0.05) & (at < 0.95)
            target = least(near, foes, begin)
            finite = lambda v, instead: np.where(np.isfinite(v), v, instead)
            forward = way[s] * lx
            head = [*[t.column[n].take(pa.array(s)) for n in (*FRAME, "team", "player_id")], t.column["player_id"].take(pa.array(m))]
            values = [dist[own], forward, np.arctan2(ly, forward), finite(pressure[r], 1.0), finite(target, 1.0), finite(target, 1.0), support, np.add.reduceat(blocks, begin, dtype=np.int64), finite(spans["width"][r], 0.0), finite(spans["length"][r], 0.0)]
            yield pa.RecordBatch.from_arrays([*head, *map(pa.array, values)], [n.split()[0] for n in CANDIDATES.split(", ")])

    return by_frame(rows, features, CANDIDATES)


def heuristic_probability(forward: Column | None = None) -> Column:
    """Completion probability without a trained model."""
    fwd = F.col("forward_progress") if forward is None else forward
    logit = (
        1.0
        - clip(F.col("distance") / 0.7, 0, 1)
        + 0.35 * clip(fwd, -0.3, 0.3)
        + 0.3 * clip(F.col("target_pressure") / 0.3, 0, 1)
        + 0.2 * clip(F.col("target_space") / 0.3, 0, 1)
        + 0.08 * clip(F.col("target_support") / 4.0, 0, 1)
        - 0.2 * clip(F.col("obstruction") / 3.0, 0, 1)
        - 0.05 * F.abs("angle") / math.pi
    )
    return sigmoid(logit - 0.65)


def fit_pass_weights(training: DataFrame, label: str, minimum: int = 10, steps: int = 500, rate: float = 0.08, penalty: float = 0.05, sample: int | None = None, local: int = 200_000) -> dict[str, float] | None:
    """Weights of the features (and of '', the intercept) for a logistic regression by gradient steps over all rows; None with fewer than minimum rows of a class.

    The features are standardised for the steps, and the weights are those of the features as they
    are. Rows with nulls are left out. Up to local rows (18 MB by default) are stepped over by the driver; more
    are packed into blocks that stay with the executors, and a step brings eleven sums from each task.
    With sample only about so many rows, chosen by a hash of their values, are taken.
    """
    rows = training.select(*[F.col(f).cast("double").alias(f) for f in FEATURES], (F.col(label).cast("double") > 0.5).cast("double").alias("y")).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    blocks = None
    try:
        measures = [F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0)), *[F.avg(f) for f in FEATURES], *[F.stddev_pop(f) for f in FEATURES]]
        n, yes, *moments = rows.agg(*measures).first()
        if min(yes, n - yes) < minimum:
            return None
        chosen = rows
        if sample is not None and n > sample:
            chosen = rows.where(F.pmod(F.xxhash64(*FEATURES, "y"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
            n, yes, *moments = chosen.agg(*measures).first()
        mean, scale = np.split(np.array(moments, float), 2)
        scale = np.where(scale < 1e-9, 1.0, scale)
        theta, shrink = np.zeros(len(FEATURES) + 1), np.append(np.full(len(FEATURES), penalty), 0.0)
        if n <= local:
            table = _matrix(chosen.toArrow())
            own = _standard(table, mean, scale)
            gradient = lambda theta: _gradient(own, theta)
        else:
            # no more tasks than cores, each with a block per batch
            few = rows.sparkSession.sparkContext.defaultParallelism
            pack = lambda batches: (pa.RecordBatch.from_arrays([pa.array([_standard(_matrix(b), mean, scale).tobytes()], pa.binary())], ["block"]) for b in batches if b.num_rows)
            blocks = chosen.repartition(few).mapInArrow(pack, "block binary").persist(StorageLevel.MEMORY_AND_DISK)
            blocks.count()
            rows.unpersist()

            def gradient(theta: np.ndarray) -> np.ndarray:
                def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    total = np.zeros(len(theta))
                    for batch in batches:
                        for b in batch.column("block"):
                            total += _gradient(np.frombuffer(b.as_buffer()).reshape(-1, len(theta) + 1), theta)
                    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

                return np.sum([r.g for r in blocks.mapInArrow(add, "g array<double>").collect()], axis=0)

        for _ in range(steps):
            theta -= rate * (gradient(theta) / n + shrink * theta)
    finally:
        rows.unpersist()
        if blocks is not None:
            blocks.unpersist()
    weight = theta[:-1] / scale
    return dict(zip(FEATURES, map(float, weight), strict=True)) | {"": float(theta[-1] - weight @ mean)}


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in (*FEATURES, "y")], 1)


def _standard(table: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The standardised features, ones and the label."""
    return np.column_stack([(table[:, :-1] - mean) / scale, np.ones(len(table)), table[:, -1]])


def _gradient(table: np.ndarray, theta: np.ndarray) -> np.ndarray:
    x = table[:, :-1]
    return x.T @ (1 / (1 + np.exp(-np.clip(x @ theta, -30, 30))) - table[:, -1])


def pass_probability(weights: dict[str, float] | None = None, direction_known: bool = True) -> Column:
    """Completion probability by fitted weights (see fit_pass_weights), else by the heuristic."""
    if weights is None:
        return heuristic_probability(None if direction_known else F.lit(0.0))
    return sigmoid(sum((F.col(f) * w if f else F.lit(w) for f, w in weights.items()), F.lit(0.0)))


def rank_passes(candidates: DataFrame, model: dict[str, float] | None = None, direction_known: bool = True, weights: dict | None = None) -> DataFrame:
    """candidates with pass_completion_probability, tactical_value, decision_score (9 decimals) and rank per frame and source."""
    return ranked(score_passes(candidates, model, direction_known, weights), F.desc("decision_score"))


def score_passes(candidates: DataFrame, model: dict[str, float] | None = None, direction_known: bool = True, weights: dict | None = None) -> DataFrame:
    """candidates with pass_completion_probability, tactical_value and decision_score."""
    out = candidates.withColumns({"pass_completion_probability": pass_probability(model, direction_known), "tactical_value": tactical_value(direction_known, weights)})
    return out.withColumn("decision_score", decision_score(F.col("tactical_value"), weights=weights))


def tactical_value(direction_known: bool = True, weights: dict | None = None) -> Column:
    w = WEIGHTS | (weights or {})
    value = (
        w["space"] * clip(F.col("target_space") / 0.3, 0, 1)
        + w["support"] * clip(F.col("target_support") / 4.0, 0, 1)
        - w["pressure"] * clip(1.0 - F.col("target_pressure") / 0.3, 0, 1)
        - w["distance"] * clip(F.col("distance") / 0.7, 0, 1)
    )
    return value + w["forward"] * clip(F.col("forward_progress") / 0.35, -1, 1) if direction_known else value


def decision_score(value: Column | None = None, weights: dict | None = None) -> Column:
    """The score (9 decimals) by pass_completion_probability and the value, by default that of the weights."""
    w = WEIGHTS | (weights or {})
    return F.round(w["probability"] * F.col("pass_completion_probability") + (tactical_value(weights=weights) if value is None else value), 9)


def ranked(candidates: DataFrame, *order: Column) -> DataFrame:
    state = Window.partitionBy(*FRAME, "team", "source_player_id")
    return candidates.withColumn("rank", F.row_number().over(state.orderBy(*order, "target_player_id"))).withColumn("n_candidates", F.count("*").over(state))


def ranked_by(candidates: DataFrame, values: dict[str, Column]) -> DataFrame:
    """candidates once per method, with rank (highest value first) and n_candidates: the candidates are made once and dealt out in one window."""
    own = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), v.cast("double").alias("value")) for m, v in values.items()]))
    state = Window.partitionBy("_m.method", *FRAME, "team", "source_player_id")
    t = candidates.withColumn("_m", own)
    t = t.withColumn("rank", F.row_number().over(state.orderBy(F.desc("_m.value"), "target_player_id"))).withColumn("n_candidates", F.count("*").over(state))
    return t.withColumn("method", F.col("_m.method")).drop("_m")


def baseline_values() -> dict[str, Column]:
    return {"nearest": -F.col("distance"), "most_forward": F.col("forward_progress"), "tas_baseline": F.col("target_space") - F.col("target_pressure") + F.col("forward_progress")}


def baseline_rankings(candidates: DataFrame) -> DataFrame:
    """Rankings by nearest teammate, most forward, and the tas baseline (space less pressure, which cancel, and progress)."""
    return ranked_by(candidates, baseline_values())


def summarize_rankings(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of compare_rankings' measures over all states, or by columns."""
    names = ("spearman", "kendall", "displacement", "score_variance")
    return compared.groupBy(*(by or [])).agg(F.count("*").alias("n_states"), *[F.avg(c).alias(c) for c in names], *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in ("top1_flip", "top_k_retained")])


def evaluate_rankings(rankings: DataFrame, targets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean reciprocal rank, NDCG, top-1 and top-3 of the actual targets; states whose target isn't ranked are left out.

    targets: match_id, frame, team, source_player_id, target_player_id.
    """
    found = rankings.join(targets, [*FRAME, "team", "source_player_id", "target_player_id"])
    r = F.col("rank")
    measures = [
        F.count("*").alias("n_states"),
        F.avg(1.0 / r).alias("mrr"),
        F.avg(1.0 / F.log2(r + F.lit(1.0))).alias("ndcg"),
        F.avg((r <= 1).cast("double")).alias("top1"),
        F.avg((r <= 3).cast("double")).alias("top3"),
        F.avg(r).alias("mean_rank"),
        F.avg(1.0 - (r - 1) / F.col("n_candidates")).alias("mean_percentile"),
    ]
    return found.groupBy(*(by or [])).agg(*measures)


def compare_rankings(clean: DataFrame, other: DataFrame, top_k: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Per state (and by): Spearman and Kendall agreement over common targets, displacement, top-1 flip, any top-k overlap."""
    key = [*by, *STATE]
    row = lambda df, side, score: df.select(*key, F.lit(side).alias("side"), "target_player_id", F.col("rank").cast("long").alias("rank"), score.cast("double").alias("score"))
    return _compared(row(clean, 0, F.lit(None)).unionByName(row(other, 1, F.col("decision_score"))), key, ["rank"], "score", top_k).drop("method")


STATE = (*FRAME, "team", "source_player_id")
MEASURES = "top1_flip boolean, top_k_retained boolean, score_variance double, n_common long, spearman double, displacement double, kendall double"


def _compared(rows: DataFrame, key: list[str], methods: list[str], score: str, top_k: int) -> DataFrame:
    """Both rankings' rows (key, side 0 or 1, target_player_id, a column per method) to a row of MEASURES per key and method.

    A method's column is its value, highest first, ties by target; the column rank is a rank already. Its
    variance is that of side 1's score, if the method is of the score. The rows are dealt and sorted by key once;
    common targets of a batch of states are compared pair by pair as arrays.
    """
    names = [m.split()[0] for m in MEASURES.split(", ")]

    def ranks(batch: pa.RecordBatch, method: str, state: np.ndarray, side: np.ndarray) -> np.ndarray:
        values = batch.column(method).to_numpy(zero_copy_only=False)
        if method == "rank":
            return values
        order = np.lexsort((-values, side, state))  # stable, so equal ones stay in order of target
        group = (2 * state + side)[order]
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values)) - np.searchsorted(group, group) + 1
        return rank

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, key):
            start = runs_of(batch, key)
            n = len(start)
            state = np.repeat(np.arange(n), np.diff(start, append=batch.num_rows))
            side, target = batch.column("side").to_numpy() > 0, codes(batch.column("target_player_id"))
            # a state's rows lie in order of target and side
            a = np.flatnonzero((state[1:] == state[:-1]) & (target[1:] == target[:-1]) & (target[1:] >= 0) & ~side[:-1] & side[1:])
            b, own = a + 1, state[a]
            total = lambda values, at=own: np.bincount(at, values, n)
            m = np.bincount(own, minlength=n)
            begin, runs = (np.cumsum(m) - m)[own], m[own]
            one = np.repeat(np.arange(len(a)), runs)
            two = np.arange(len(one)) - np.repeat(np.cumsum(runs) - runs - begin, runs)
            known = batch.column(score).to_numpy(zero_copy_only=False)[b]
            fine = ~np.isnan(known)
            counted = total(fine.astype(float))
            for method in methods:
                rank = ranks(batch, method, state, side)
                ra, rb = rank[a], rank[b]
                da, db = ra[one] - ra[two], rb[one] - rb[two]
                place = lambda d: np.bincount(one, d > 0, len(a))
                first = np.full((2, n), -1)
                top = np.flatnonzero(rank == 1)
                first[side[top].astype(int), state[top]] = target[top]
                with np.errstate(invalid="ignore", divide="ignore"):
                    spearman = np.where(m > 1, 1.0 - 6.0 * total((place(da) - place(db)) ** 2) / (m * (m * m - 1.0)), 1.0)
                    kendall = np.where(m > 1, total(np.sign(da * db), own[one]) / (m * (m - 1.0)), 1.0)
                    spread = total(np.where(fine, known - (total(np.where(fine, known, 0.0)) / counted)[own], 0.0) ** 2) / counted
                    moved = total(np.abs(ra - rb)) / m
                scored = (counted > 0) & (method in (score, "rank"))
                values = [first[0] != first[1], total((ra <= top_k) & (rb <= top_k)) > 0, pa.array(spread, mask=~scored), m, *[pa.array(v, mask=m == 0) for v in (spearman, moved, kendall)]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(start)) for c in key], *map(pa.array, values), pa.array([method] * n)], [*key, *names, "method"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in key], MEASURES, "method string"])
    return rows.repartition(*key).sortWithinPartitions(*key, "target_player_id", "side").mapInArrow(measure, schema)


def weight_sensitivity(candidates: DataFrame, targets: DataFrame, profiles: dict[str, dict] | None = None) -> DataFrame:
    """evaluate_rankings by profile of weights: the candidates are made once and dealt to all profiles."""
    scores = {p: decision_score(weights=w) for p, w in (profiles or PROFILES).items()}
    return evaluate_rankings(ranked_by(candidates.withColumn("pass_completion_probability", pass_probability()), scores), targets, ["method"]).withColumnRenamed("method", "profile")


def select_scenarios(states: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One state per label, the best by its column that no earlier label took: label, state_id, value."""
    out, taken = None, None
    for label, column in labels.items():
        free = states if taken is None else states.join(taken, "state_id", "left_anti")
        best = free.orderBy(F.desc(column), "state_id").limit(1).select(F.lit(label).alias("label"), "state_id", F.col(column).cast("double").alias("value"))
        out = best if out is None else out.unionByName(best)
        taken = out.select("state_id")
    return out


def ranking_report(rankings: DataFrame, targets: DataFrame, methods: list[str]) -> DataFrame:
    """A row per method, zeros where no state's target was ranked: n_states, mrr, top1, top3, mean_rank."""
    names = ["n_states", "mrr", "top1", "top3", "mean_rank"]
    found = evaluate_rankings(rankings, targets, ["method"]).select("method", *names)
    asked = rankings.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    return asked.join(found, "method", "left").fillna(0, names)


def ranking_grid(tracking: DataFrame, sources: DataFrame, perturbations: list[str], severities: list[str], seed: int, top_k: int = 3) -> DataFrame:
    """Agreement of rankings of clean and perturbed states: a row per method, perturbation and severity.

    Methods: the decision score and the baselines. Each row is dealt to all cells, whose scales and shares
    are columns; the cells go through the candidates together, told apart by a suffix of match_id, and a
    candidate's row bears the values of all methods. So neither the plan nor its scans grow with the cells, nor
    the rows with the methods. Rates of flips and changes are over all states, the other means over those with
    common targets.
    """
    cells = F.array(*[noise_cell(f"{p}|{s}", p, s) for p in perturbations for s in severities])
    seen = tracking.where("visible")
    tagged = lambda df: df.withColumn("match_id", F.concat_ws("|", "match_id", "_cell.name")).drop("_cell")
    every = lambda df: tagged(df.withColumn("_cell", F.explode(cells)))
    values = baseline_values() | {"decision": F.col("decision_score")}

    def valued(candidates: DataFrame, side: int) -> DataFrame:
        return score_passes(candidates).select(*STATE, F.lit(side).alias("side"), "target_player_id", *[v.alias(m) for m, v in values.items()])

    both = every(valued(pass_candidates(seen, sources), 0)).unionByName(valued(pass_candidates(tagged(perturb_cells(seen, cells, seed)), every(sources)), 1))
    compared = _compared(both, list(STATE), list(values), "decision", top_k)
    part = lambda i: F.element_at(F.split("match_id", r"\|"), i)
    valid = F.col("n_common") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(valid, c.cast("double"))), F.lit(0.0))
    return compared.groupBy("method", part(-2).alias("perturbation"), part(-1).alias("severity")).agg(
        F.count("*").alias("n_states"), F.count_if(valid).alias("n_valid"), mean(~F.col("top1_flip")).alias("top1_retention"), mean(F.col("top_k_retained")).alias("top_k_retention"),
        *[mean(F.col(c)).alias(c) for c in ("spearman", "kendall", "displacement", "score_variance")],
        F.avg(F.col("top1_flip").cast("double")).alias("flip_rate"), (1.0 - F.avg(F.col("top_k_retained").cast("double"))).alias("changed_rate"),
    )
