"""Exact top-k inner products: ball trees over shards of space, branch and bound, a shared and rising kth score.

Equal vectors are one point of the trees, with their few least ids. Points are dealt to shards by
space: an upper tree, fitted on a bounded sample, splits along lines between far points. Each shard
builds a ball tree; of its root, centre and radius go into a small table that all tasks read. An
inner product with a point of a ball is at most q·centre + |q|·radius. So each query first asks the
shard with the highest bound; then, in waves, those next in order whose bound still reaches its kth
score so far. Only for these pairs of query and shard does a tree meet queries. In a shard, nodes
below the bound are left out, and leaves are visited from the largest upper bound down.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import cut

#: Points wanted in a shard, the most shards (so that their roots fit a broadcast), queries that meet a tree at once, points of a leaf.
SHARD_ROWS, SHARDS, BLOCK_ROWS, LEAF = 8192, 1 << 14, 1024, 64
#: Bound of the sample on which the upper tree is fitted, and shards that a query asks in each wave (the last takes the rest).
SAMPLE, WAVES = 16384, (1, 7, None)
EXACT = 1 << 53


class Tree:
    """A ball tree in arrays, level by level; rows are sorted by leaf, then id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((*vectors.T[::-1], ids)) if len(ids) else np.arange(0)
        ids, vectors = ids[order], vectors[order]
        point = vectors.astype(np.float64)
        parts, levels = [np.arange(len(ids))], []
        while True:
            centre = np.array([point[p].mean(0) for p in parts])
            radius = np.array([np.sqrt(((point[p] - c) ** 2).sum(1).max()) for p, c in zip(parts, centre, strict=True)])
            levels.append((centre, radius))
            if max(map(len, parts)) <= LEAF:
                break
            parts = [half for p in parts for half in self.halves(point, p)]
        self.levels = levels
        self.parts = [np.sort(p) for p in parts]
        self.ids, self.vectors = ids, vectors
        self.largest = int(np.abs(vectors).max(initial=0))

    @staticmethod
    def halves(point: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Two halves (so all parts of a level are about even) along the line between two far points."""
        order = np.argsort(point[own] @ far_line(point[own]), kind="stable")
        return [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]

    def search(self, queries: np.ndarray, k: int, score: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, id, score) of rows that beat each query's bound (score, id), k at most for a query."""
        q = queries.astype(np.float64)
        norm = np.sqrt((q * q).sum(1))
        score, at = score.copy(), at.copy()
        exact = queries.shape[1] * int(np.abs(queries).max(initial=0)) * self.largest < EXACT
        qi, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        bound = np.zeros(0)
        for depth, (centre, radius) in enumerate(self.levels):
            if depth:
                qi, node = np.repeat(qi, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
            bound = upper_bound(np.einsum("ij,ij->i", q[qi], centre[node]), norm[qi], radius[node])
            live = bound >= score[qi]
            qi, node, bound = qi[live], node[live], bound[live]
        order = np.lexsort((-bound, qi))
        qi, node, bound = qi[order], node[order], bound[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        best = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int64 if exact else object)]
        first, wave = 0, 1
        while len(qi):
            now = (rank >= first) & (rank < first + wave) & (bound >= score[qi])
            found = [best]
            for leaf in np.unique(node[now]):
                rows, asked = self.parts[leaf], qi[now & (node == leaf)]
                if not len(rows):
                    continue
                s = np.rint(q[asked] @ self.vectors[rows].T.astype(np.float64)).astype(np.int64) if exact else queries[asked].astype(object) @ self.vectors[rows].T.astype(object)
                ids = self.ids[rows]
                good = (s > score[asked, None]) | ((s == score[asked, None]) & (ids[None] <= at[asked, None]))
                i, j = np.nonzero(good)
                found.append([asked[i], ids[j], s[i, j]])
            own, ids, s = (np.concatenate([f[c] for f in found]) for c in range(3))
            order = np.lexsort((ids, -s, own))
            own, ids, s = own[order], ids[order], s[order]
            place = np.arange(len(own)) - np.searchsorted(own, own)
            kth = place == k - 1
            score[own[kth]], at[own[kth]] = s[kth].astype(np.float64), ids[kth]
            best = [x[place < k] for x in (own, ids, s)]
            left = (rank >= first + wave) & (bound >= score[qi])
            qi, node, bound, rank = qi[left], node[left], bound[left], rank[left]
            first, wave = first + wave, wave * 2
        return tuple(best)


def far_line(p: np.ndarray) -> np.ndarray:
    """The line between two points of p that lie far apart."""
    a = p[((p - p[0]) ** 2).sum(1).argmax()]
    return p[((p - a) ** 2).sum(1).argmax()] - a


def upper_bound(product: np.ndarray, norm: np.ndarray, radius: np.ndarray) -> np.ndarray:
    bound = product + norm * radius
    return bound + 1e-6 + 1e-9 * np.abs(bound)


def fit_space(sample: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the lines and middles by which its nodes part space; a node without two sample points sends all to the left."""
    parts, out = [sample], []
    for _ in range(levels):
        lines = np.array([far_line(p) if len(p) > 1 else np.zeros(sample.shape[1]) for p in parts])
        sides = [p @ x for p, x in zip(parts, lines, strict=True)]
        middles = np.array([np.median(s) if len(s) > 1 else 0.0 for s in sides])
        out.append((lines, middles))
        parts = [half for p, s, m in zip(parts, sides, middles, strict=True) for half in (p[s <= m], p[s > m])]
    return out


def route(space: list[tuple[np.ndarray, np.ndarray]], points: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for lines, middles in space:
        node = 2 * node + (np.einsum("ij,ij->i", points, lines[node]) > middles[node])
    return node


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (array of long), dim. Null ids, null or empty vectors and null or non-finite components take no part."""
    fine = F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))) & (F.size(vector_col) > 0)
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v")).withColumn("dim", F.size("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every the k largest inner products with other rows.

    Components count as floor(scale * x). Ties go to the smaller vec_id. Only vectors of one length
    are compared. Each row but the query's own is a candidate, so repeated rows count each, and other
    rows of the query's id too; repeats of a query row ask once. Fewer than k others give fewer rows;
    an empty table none. A score beyond 64 bits raises an error.
    """
    every_row = cut(quantised(vectors, id_col, vector_col, scale))
    queries = every_row.where(F.col("id") % every == 0).distinct()
    # k + 1 rows of equal vectors are enough: a query may be one of them. The limit works before the shuffle too.
    rows = cut(every_row.withColumn("r", F.row_number().over(Window.partitionBy("dim", "v").orderBy("id"))).where(F.col("r") <= k + 1).drop("r"))
    found = search(rows, queries.select("dim", "v").distinct(), k + 1)
    lists = found.groupBy("dim", "v").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("best"))
    own = queries.join(lists, ["dim", "v"])  # one of the hits that have the query's own vector and id is itself
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    best = F.transform("best", lambda x, i: F.struct(x["down"].alias("down"), x["vec_id"].alias("vec_id"), i.alias("i")))
    itself = F.array_min(F.transform(F.filter(best, lambda x: (x["vec_id"] == F.col("id")) & (x["down"] == -norm)), lambda x: x["i"]))
    kept = F.slice(F.filter(best, lambda x: itself.isNull() | (x["i"] != itself)), 1, k)
    out = own.select(F.col("id").alias("query_id"), F.posexplode(kept).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.down")).alias("score"))


def search(rows: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """dim, v, vec_id, score: for each vector of asks (dim, v) the k largest inner products with rows (id, v, dim)."""
    spark = rows.sparkSession
    n = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    levels = {d: int(np.ceil(np.log2(min(SHARDS, max(1, c / SHARD_ROWS))))) for d, c in n.items()}
    space = {}
    for d, c in n.items():
        part = rows.where(F.col("dim") == d).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE) if levels[d] else None
        space[d] = fit_space(matrix(part.toArrow().column("v"), d).astype(np.float64), levels[d]) if levels[d] else []
    spaces = spark.sparkContext.broadcast(space)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                part = batch.filter(pa.array(dim == d))
                shard = route(spaces.value[d], matrix(part.column("v"), d).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shard.astype(np.int32))], [*part.schema.names, "shard"])

    def build(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        tree = Tree(group.column("id").to_numpy(), matrix(group.column("v"), dim))
        centre, radius = tree.levels[0]
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": group.column("shard")[:1].combine_chunks(), "centre": pa.array(centre.tolist(), pa.list_(pa.float64())), "radius": pa.array(radius), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    dealt = rows.mapInArrow(deal, "id long, v array<long>, dim int, shard int").groupBy("dim", "shard")
    trees = cut(dealt.applyInArrow(build, "dim int, shard int, centre array<double>, radius double, tree binary"))
    roots: dict[int, list] = {}
    for r in trees.select("dim", "shard", "centre", "radius").collect():  # at most SHARDS for a length of vectors
        roots.setdefault(r.dim, []).append((r.shard, r.centre, r.radius))
    known = spark.sparkContext.broadcast({d: (np.array([s for s, _, _ in x]), np.array([c for _, c, _ in x]), np.array([r for _, _, r in x])) for d, x in roots.items()})

    def plan(first: int, last: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                dims = whole.column("dim").to_numpy()
                for d in np.unique(dims).tolist():
                    if d not in known.value:
                        continue
                    shard, centre, radius = known.value[d]
                    mine = whole.filter(pa.array(dims == d))
                    for a in range(0, mine.num_rows, BLOCK_ROWS):
                        batch = mine.slice(a, BLOCK_ROWS)
                        q = matrix(batch.column("v"), d).astype(np.float64)
                        bound = upper_bound(q @ centre.T, np.sqrt((q * q).sum(1))[:, None], radius[None])
                        order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                        score = batch.column("score").to_numpy(zero_copy_only=False).astype(np.float64)
                        score = np.where(np.isnan(score), -np.inf, score)
                        i, j = np.nonzero(np.take_along_axis(bound, order, 1) >= score[:, None])
                        taken = batch.take(pa.array(i))
                        yield pa.RecordBatch.from_arrays([pa.array(shard[order[i, j]].astype(np.int32)), *(taken.column(c) for c in ("dim", "v", "score", "at"))], ["shard", "dim", "v", "score", "at"])

        return run

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs of the queries that ask a shard, BLOCK_ROWS at most each."""
        for batch in batches:
            dim = batch.column("dim")[0].as_py()
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                score = part.column("score").to_numpy(zero_copy_only=False).astype(np.float64)
                packed = pickle.dumps((matrix(part.column("v"), dim), np.where(np.isnan(score), -np.inf, score), part.column("at").fill_null(np.iinfo(np.int64).max).to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column("dim")[:1], part.column("shard")[:1], pa.array([packed], pa.binary())], ["dim", "shard", "queries"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, packed in zip(batch.column("tree"), batch.column("queries"), strict=True):
                v, score, at = pickle.loads(packed.as_py())
                own, found, s = pickle.loads(tree.as_py()).search(v, k, score, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), v.shape[1], np.int32)), pa.array(v[own].tolist(), pa.list_(pa.int64())), pa.array(found), pa.array(s.tolist(), pa.int64())], ["dim", "v", "vec_id", "score"])

    hits = "dim int, v array<long>, vec_id long, score long"
    order = Window.partitionBy("dim", "v").orderBy(F.desc("score"), "vec_id")
    asks = cut(asks)
    best, first = None, 0
    for width in WAVES:
        last = None if width is None else first + width
        if first and first >= max((len(x) for x in roots.values()), default=0):
            break
        bound = asks.select("dim", "v", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("at"))
        if best is not None:
            kth = best.where(F.col("r") == k).select("dim", "v", F.col("score").cast("double").alias("score"), F.col("vec_id").alias("at"))
            bound = asks.join(kth, ["dim", "v"], "left")
        asked = bound.mapInArrow(plan(first, last), "shard int, dim int, v array<long>, score double, at long")
        packed = asked.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(16))).groupBy("dim", "shard", "part").applyInArrow(pack, "dim int, shard int, queries binary")
        found = packed.join(trees.select("dim", "shard", "tree"), ["dim", "shard"]).mapInArrow(answer, hits)
        every = found if best is None else best.drop("r").unionByName(found)
        best = cut(every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k))
        first = last
    return best.select("dim", "v", "vec_id", "score")
