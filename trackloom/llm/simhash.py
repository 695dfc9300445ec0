"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints give the exact Hamming links.

Distinct fingerprints are dealt to shards by a vantage-point tree: a node sends points at distance
mu or less of its vantage point to the left, others to the right. If two points are within radius
r of each other and the tree parts them, the triangle bound puts the left one at a distance over
mu - r; so such points go to both sides, and each pair in reach meets in a shard. Inside a shard
the same rule builds a tree down to small leaves. Shards return components, not pairs; points that
stand in several shards tie these together, and large-star/small-star rounds finish the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import ASCII_LOWER, cut, join_hot, lists, pieces, utf8
from trackloom.llm.components import connected_components

SEED, BITS = 42, 64
#: Bound of the sample of distinct fingerprints on which the upper tree is fitted, and points wanted in a shard.
SAMPLE, SHARD_POINTS = 16384, 1000
#: Sample points that a node must have to be fitted; below it, vantage points come from a hash of the node's number.
FITTED = 24
LEAF = 96


def lanes_table() -> np.ndarray:
    """For each byte value a word whose 8 bytes are its 8 bits, so that sums of up to 255 words count bits."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return bits.copy().view("<u8").ravel()


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of words words, ASCII lower-cased and joined by spaces; of all words if fewer; [] if none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.translate(ASCII_LOWER).split()
    if len(found) <= words:
        return [digest(b" ".join(found), SEED)] if found else []
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    return [digest(joined[a:b], SEED) for a, b in zip((ends - size).tolist(), ends[words - 1 :].tolist(), strict=False)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint per document: bits set in over half of its hashes; zero without any."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if not full.any():
        return out
    n = counts[full]
    start = np.cumsum(n) - n
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    lanes = lanes_table()[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.repeat(start, parts) + within * 255, axis=0).view(np.uint8).reshape(-1, BITS)
    sums = np.add.reduceat(sums.astype(np.int64), first, axis=0)
    out[full] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a long) for each row of docs; null, empty and blank texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hashes = [shingle_hashes(x, words) for x in lists(*utf8(piece.column("text")))]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(majority_bits(flat, counts).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def hashed_point(node: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit point for a node's number (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def best_split(points: np.ndarray, radius: int, tries: int = 8) -> tuple[int, int, int]:
    """Of a few candidates the vantage point and mu whose larger side is least, counting both-sided points twice."""
    best = None
    for v in points[:: max(1, len(points) // tries)][:tries]:
        reach = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=BITS + 1))
        mu = np.arange(BITS)
        right = len(points) - np.concatenate([np.zeros(radius, np.int64), reach[: BITS - radius]])
        larger = np.maximum(reach[mu], right)
        at = int(np.argmin(larger))
        if best is None or larger[at] < best[0]:
            best = (int(larger[at]), int(v), at)
    return best


def fit_tree(sample: np.ndarray, levels: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and mu by node number (root 1); nodes with few sample points take hashed points and mu 32."""
    depth = min(levels, max(1, int(np.log2(max(2, len(sample) // FITTED))) + 1)) if levels else 0
    vantage = hashed_point(np.arange(1 << depth))
    mu = np.full(1 << depth, BITS // 2 - 1, np.int64)
    inside = {1: sample}
    for node in range(1, 1 << depth):
        points = inside.pop(node, sample[:0])
        if len(points) >= FITTED:
            _, v, m = best_split(points, radius)
            vantage[node], mu[node] = v, m
            d = np.bitwise_count(points ^ np.uint64(v)).astype(np.int64)
            inside[2 * node], inside[2 * node + 1] = points[d <= m], points[d > m - radius]
    return vantage, mu


def route(points: np.ndarray, vantage: np.ndarray, mu: np.ndarray, levels: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of a point and shard number, for each shard where it belongs."""
    which, node = np.arange(len(points)), np.ones(len(points), np.int64)
    for _ in range(levels):
        known = node < len(vantage)
        near = np.where(known, node, 0)
        v = np.where(known, vantage[near], hashed_point(node))
        m = np.where(known, mu[near], BITS // 2 - 1)
        d = np.bitwise_count(points[which] ^ v).astype(np.int64)
        left, right = d <= m, d > m - radius
        which, node = np.concatenate([which[left], which[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    return which, node


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; label holds the least member's index."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label[:] = up


def shard_components(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the index of the least point that it reaches by steps of radius bits or less."""
    label = np.arange(len(points))
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        p = points[own]
        if len(own) > LEAF:
            larger, v, mu = best_split(p, radius, 4)
            if larger <= 0.9 * len(own):
                d = np.bitwise_count(p ^ np.uint64(v)).astype(np.int64)
                stack += [own[d <= mu], own[d > mu - radius]]
                continue
        for first in range(0, len(own), 256):  # a leaf, or points too close together to part: blocks of all pairs, none kept
            i, j = np.nonzero(np.bitwise_count(p[first : first + 256, None] ^ p[None, first:]) <= radius)
            far = i < j
            merge(label, own[first + i[far]], own[first + j[far]])
    return label


def components(points: DataFrame, radius: int = 2) -> DataFrame:
    """points: id, fp. Returns id, fp, component_id: the least id reachable by links of radius bits or fewer.

    Equal fingerprints are one point of the tree. A null id keeps its row and counts for nothing.
    """
    points = cut(points.select("id", "fp"))
    distinct = cut(points.groupBy("fp").agg(F.min("id").alias("least")))
    n = distinct.count()
    levels = int(np.ceil(np.log2(max(1, n / SHARD_POINTS))))
    sample = np.array([r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    vantage, mu = fit_tree(sample, levels, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            which, node = route(fp.view(np.uint64), vantage, mu, levels, radius)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(fp[which])], ["shard", "fp"])

    def link(group: pa.Table) -> pa.Table:
        fp = np.sort(group.column("fp").to_numpy())
        root = shard_components(fp.view(np.uint64), radius)
        return pa.table({"fp": fp, "root": fp[root]})

    member = distinct.select("fp").mapInArrow(deal, "shard long, fp long").groupBy("shard").applyInArrow(link, "fp long, root long")
    member = cut(member.groupBy("fp").agg(F.array_sort(F.collect_set("root")).alias("roots")))
    ties = member.where(F.size("roots") > 1).select(F.col("roots")[0].alias("v"), F.explode("roots").alias("u"))
    roots = connected_components(ties).withColumnRenamed("node", "r")
    own = distinct.join(member.select("fp", F.col("roots")[0].alias("r")), "fp").join(roots, "r", "left").select("fp", "least", F.coalesce("root", "r").alias("root"))
    own = cut(own)
    named = own.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    several = own.join(named.where("n > 1").drop("n"), "root").select("fp", "component_id")
    fp_names = distinct.join(several, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return join_hot(points, fp_names, "fp").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, **columns: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    out = components(fingerprints(docs, words, **columns), radius)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
