"""Groups of near copies: SimHash links of whole and of partial fingerprints, verified by shingle similarity.

Two bits of 64 reach texts that differ in a few words; a similarity of 0.8 moves ten bits and more,
and at such a radius no vantage point parts anything. So besides the fingerprint of all shingles,
whose links come from the vantage-point trees, each document has a fingerprint per class of
shingles (by hash): a near copy leaves several of the classes as they were, and their fingerprints
are equal. So that a class is small in long texts too, the classes of each level hold half the
shingles (again by hash) of those of the level below; a document has the level of its size, and the
next one if a near copy of it could be as large as that.

Texts with the same set of shingles are one. Documents with an equal fingerprint, and those that
SimHash links tie together, are a group, in which any two may be near copies. All members are
compared with two of them, the least id and the one that shares most, and those whose shingle sets
have a Jaccard similarity of the threshold or more are linked. So that a frequent line does not
bring all its documents together, a text small enough to use all its shingles stands only in the
groups of its rarest classes: as many as a near copy can change, and one more.

Where that leaves a group in parts, its members may still be near copies of each other. They are
posted under their rarest shingles: with these in one order for all, from the rarest on, two sets as
similar as the threshold have their first common shingle so early in both that enough others can
follow. Texts that differ in words of their own have no such shingle and never meet; those that meet
are compared with more and more heads, until links join them or all pairs that can be similar by
size and place of that shingle were compared.

Beyond SKETCH shingles an estimate from the SKETCH least hashes settles only what is far from the
threshold; the other pairs are judged by all their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import binary, cut, join_hot, lists, pieces, utf8, written
from trackloom.llm.components import connected_components
from trackloom.llm.simhash import components, majority_bits, shingle_hashes

#: Classes of shingles, shingles of a document in all classes of its level (this to twice this many), and hashes of the similarity sketch.
CLASSES, SAMPLED, SKETCH = 32, 96, 256
#: Heads of a rare shingle's group in the first round, and how many times as many each further round has.
HEADS, MORE = 64, 16
#: How many narrow rows one with a sketch or a text's shingles stands for.
WIDE = 16
#: An estimate counts where chance would give one so far beyond the threshold in less than one of e ** DOUBT pairs.
DOUBT = 24


def level_of(shingles: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(shingles / SAMPLED, 1))).astype(np.int64)


def features(docs: DataFrame, words: int, similar: float, id_col: str, text_col: str) -> DataFrame:
    """id, same, fp, shingles (their number), spare, classes and parts (a fingerprint for each class that has shingles).

    same: a hash of the set of shingles, the sum of theirs (null without any).
    spare: shingles that a near copy may lack or have besides, and one, less the classes of level 0. Above 0, a near copy may share no class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=2 << 20):
            rows = piece.num_rows
            hashes = [shingle_hashes(x, words) for x in lists(*utf8(piece.column("text")))]
            counts = np.fromiter(map(len, hashes), np.int64, rows)
            flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(counts.sum()))
            whole = majority_bits(flat, counts).view(np.int64)
            key = np.repeat(np.arange(rows, dtype=np.uint64), counts) << np.uint64(32) | (flat * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
            order = np.argsort(key)
            fresh = np.concatenate([[True], np.diff(key[order]) > 0])[: len(key)]
            key, flat = key[order][fresh], flat[order][fresh]
            owner = (key >> np.uint64(32)).astype(np.int64)
            n = np.bincount(owner, minlength=rows)
            levels = np.stack([level_of(n), level_of(n / similar)], 1)
            class_ = ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(59)).astype(np.int64) % CLASSES
            draw = ((flat ^ (flat >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
            cell, used = [], []
            for side in (0, 1):
                use = draw << levels[owner, side].astype(np.uint64) < np.uint64(1 << 32)
                if side:
                    use &= (levels[:, 0] < levels[:, 1])[owner]
                cell.append(((2 * owner + side) * CLASSES + class_)[use])
                used.append(flat[use])
            cell, used = np.concatenate(cell), np.concatenate(used)
            size = np.bincount(cell, minlength=2 * rows * CLASSES)
            part = majority_bits(used[np.argsort(cell, kind="stable")], size).view(np.int64)
            (own,) = np.nonzero(size)
            at = pa.array(np.searchsorted(own, 2 * CLASSES * np.arange(rows + 1)), pa.int32())
            number = levels.ravel()[own // CLASSES] * CLASSES + own % CLASSES
            low = np.bincount(own[number < CLASSES] // (2 * CLASSES), minlength=rows)
            spare = np.floor(n * (1 - similar) / similar + 1e-6).astype(np.int64) + 1 - low
            mixed = (flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            same = np.add.reduceat(np.append(mixed, np.uint64(0)), np.cumsum(n) - n).view(np.int64)
            columns = [piece.column("id"), pa.array(same, mask=n == 0), pa.array(whole), pa.array(n, pa.int32()), pa.array(spare, pa.int32()), pa.ListArray.from_arrays(at, pa.array(number, pa.int32())), pa.ListArray.from_arrays(at, pa.array(part[own]))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "same", "fp", "shingles", "spare", "classes", "parts"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    return own.mapInArrow(run, "id long, same long, fp long, shingles int, spare int, classes array<int>, parts array<long>")


def similarity(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Jaccard similarity of pairs of sketches, from the least hashes of their union: of all shingles where neither is full."""
    size = np.array([[len(x) // 4, len(y) // 4] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    pair = np.concatenate([np.repeat(np.arange(len(size)), size[:, side]) for side in (0, 1)]).astype(np.uint64)
    key = np.sort(pair << np.uint64(32) | np.frombuffer(b"".join([*a, *b]), "<u4").astype(np.uint64))
    key, times = np.unique(key, return_counts=True)
    pair = (key >> np.uint64(32)).astype(np.int64)
    rank = np.arange(len(key)) - np.searchsorted(pair, pair)
    seen = rank < np.where((size == SKETCH).any(1), SKETCH, np.iinfo(np.int64).max)[pair]
    shared = np.bincount(pair[seen], times[seen] > 1, len(size))
    return shared / np.maximum(np.bincount(pair[seen], minlength=len(size)), 1)


def in_doubt(estimate: np.ndarray, least: float) -> np.ndarray:
    """Whether a pair with this estimate from SKETCH hashes can be on the other side of the threshold (Chernoff's bound)."""
    p = np.clip(estimate, 1e-12, 1 - 1e-12)
    return SKETCH * (p * np.log(p / least) + (1 - p) * np.log((1 - p) / (1 - least))) < DOUBT if least < 1 else estimate == 1


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float, rows: int | None = None, n: int | None = None) -> DataFrame:
    """The pairs (u, v), rows of them, whose documents are similar. texts: id, text, n of them; only those of the pairs are looked at."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = similarity(a, b)
            full = np.fromiter((max(len(x), len(y)) == 4 * SKETCH for x, y in zip(a, b, strict=True)), bool, len(a))
            doubt = full & in_doubt(found, least)
            keep = pa.array(np.flatnonzero(doubt | (found >= least)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in ("u", "v")), pa.array(doubt).take(keep)], ["u", "v", "doubt"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=2 << 20):
            sets = [np.unique(np.array(shingle_hashes(x, words), np.uint64)) for x in lists(*utf8(piece.column("text")))]
            least = [np.sort(x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32))[:SKETCH].astype("<u4").tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([piece.column("id"), binary(least), binary([x.astype("<u8").tobytes() for x in sets])], ["id", "sketch", "hashes"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= least * (len(x) + len(y) - shared) - 1e-9:
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("u", "v")], ["u", "v"])

    def both(pairs: DataFrame, of: DataFrame, what: str) -> DataFrame:
        sides = [of.select(F.col("id").alias(c), F.col(what).alias(name)) for c, name in (("u", "a"), ("v", "b"))]
        return pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "a", "b")

    needed = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = written(texts.join(needed, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(shingles, "id long, sketch binary, hashes binary"), "near-copies-sets", n and WIDE * n)
    seen = cut(both(pairs, sets, "sketch").mapInArrow(estimate, "u long, v long, doubt boolean"), rows and WIDE * rows)
    doubt = seen.where("doubt").select("u", "v")
    return seen.where("NOT doubt").select("u", "v").unionByName(both(doubt, sets, "hashes").mapInArrow(judge, "u long, v long"))


def candidate_groups(own: DataFrame, radius: int) -> DataFrame:
    """class, fp, id, shingles, weight: the groups (class, fp) in which near copies meet; class -1 has the SimHash components."""
    rows = own.select("id", F.explode(F.arrays_zip("classes", "parts")).alias("x")).select("id", F.col("x.classes").alias("class"), F.col("x.parts").alias("fp"))
    sizes = rows.groupBy("class", "fp").agg(F.count("*").alias("n")).where("n > 1")
    low, mine = F.col("class") < CLASSES, Window.partitionBy("id")
    place = F.row_number().over(mine.orderBy(~low, "n", "class", "fp"))  # after the classes that no other document has
    several = rows.join(sizes, ["class", "fp"]).join(own.select("id", "shingles", "spare"), "id").withColumns({"place": place, "all": F.count_if(low).over(mine), "weight": F.round(F.sum(F.log2("n")).over(mine), 6)})
    several = several.where(~low | (F.col("place") <= F.col("all") + F.col("spare"))).select("class", "fp", "id", "shingles", "weight")
    open_ = own.where("shingles > 0 AND spare > 0")  # the others share one of those classes with each near copy
    whole = components(open_.select("id", "fp"), radius).select(F.lit(-1).alias("class"), F.col("component_id").alias("fp"), "id")
    return several.unionByName(whole.join(open_.select("id", "shingles"), "id").withColumn("weight", F.lit(0.0)))


def rare_postings(texts: DataFrame, words: int, similar: float) -> DataFrame:
    """shingle, place, id, shingles: the rarest shingles of each text (id, text), among which two similar ones have their first common one.

    place: how many shingles of the text come before it, in order of the texts that have them. Stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            own = [np.unique(np.array(shingle_hashes(x, words), np.uint64)) for x in lists(*utf8(piece.column("text")))]
            n = np.array([len(x) for x in own], np.int64)
            columns = [piece.column("id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat(n, n), pa.int32()), pa.array(np.concatenate(own).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "shingles", "shingle"])

    every = written(texts.mapInArrow(run, "id long, shingles int, shingle long"), "near-copies-shingles")
    shared = every.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("id")
    rows = every.join(shared, "shingle").withColumns({"after": F.row_number().over(own.orderBy("n", "shingle")) - 1, "all": F.count("*").over(own)})
    rows = rows.withColumn("place", F.col("shingles") - F.col("all") + F.col("after")).where(F.col("shingles") - F.col("place") >= similar * F.col("shingles") - 1e-6)
    return cut(rows.select("shingle", "place", "id", "shingles"), every.count())


def near_copies(docs: DataFrame, words: int = 5, similar: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, group_id for each document that is not the least id of its group of near copies.

    Repeated rows of one id are one document; null ids, and null, empty and blank texts, are in no group.
    """
    every = written(features(docs, words, similar, id_col, text_col), "near-copies-features")
    n = every.count()
    first = every.where("same IS NOT NULL").groupBy("same", "shingles").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    own = written(every.drop("same").join(first.select(F.col("first").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]), "near-copies-own", WIDE * n)
    copies = join_hot(every.where("same IS NOT NULL").select("id", F.struct("same", "shingles").alias("set")), first.where("n > 1").select(F.struct("same", "shingles").alias("set"), "first"), "set")
    copies = cut(copies.where("id <> first").distinct().select(F.col("id").alias("node"), F.col("first").alias("root")), n)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    # all members of a group with two of them
    group = ["class", "fp"]
    in_groups = own.agg(F.coalesce(F.sum(F.size("classes") + 1), F.lit(0))).first()[0]
    members = cut(candidate_groups(own, radius), in_groups)
    heads = members.groupBy(*group).agg(F.min("id").alias("least"), F.max_by("id", F.struct("weight", -F.col("id"))).alias("middle"), F.count("*").alias("n")).where("n > 1")
    heads = heads.select(*group, F.explode(F.array_distinct(F.array("least", "middle"))).alias("h"))
    heads = heads.join(own.select(F.col("id").alias("h"), F.col("shingles").alias("s")), "h")
    fits = F.least("shingles", "s") >= similar * F.greatest("shingles", "s") - 1e-6
    pairs = members.join(heads, group).where((F.col("id") != F.col("h")) & fits)
    tried = cut(pairs.select(F.greatest("id", "h").alias("u"), F.least("id", "h").alias("v")).distinct(), 2 * in_groups)
    size = tried.count()
    roots = connected_components(verified(tried, texts, words, similar, size, n), size)

    # what these links leave in parts, by rare shingles
    at = with_roots(members, roots)
    apart = at.groupBy(*group).agg((F.min("root") < F.max("root")).alias("parts")).where("parts").select(*group)
    left = at.join(apart, group).select("id").distinct()
    members = rare_postings(texts.join(left, "id", "left_semi").dropDuplicates(["id"]), words, similar)
    postings, wanted = members.count(), HEADS
    while True:
        at = with_roots(members, roots)
        parts = at.groupBy("shingle", "root").agg(F.count("*").alias("size"))
        apart = parts.groupBy("shingle").agg(F.count("*").alias("parts")).where("parts > 1")
        draw = F.xxhash64("id", F.lit(wanted)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
        at = at.join(parts, ["shingle", "root"]).join(apart, "shingle").withColumn("head", draw * F.col("parts") * F.col("size") < wanted)
        at = cut(at.select("shingle", "place", "id", "shingles", "root", "head"), postings)
        if at.isEmpty():
            break
        heads = at.where("head").select("shingle", F.col("place").alias("p"), F.col("id").alias("h"), F.col("root").alias("r"), F.col("shingles").alias("s"))
        reach = F.least(F.col("shingles") - F.col("place"), F.col("s") - F.col("p")) * (1 + similar) >= similar * (F.col("shingles") + F.col("s")) - 1e-6
        pairs = at.join(heads, "shingle").where((F.col("root") != F.col("r")) & fits & reach).select(F.greatest("id", "h").alias("u"), F.least("id", "h").alias("v")).distinct()
        pairs = cut(pairs.join(tried, ["u", "v"], "left_anti"))
        tried = tried.unionByName(pairs)
        size = pairs.count()
        links = verified(pairs, texts, words, similar, size, n)
        roots = connected_components(links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), size + n)
        members = at.where("NOT head").select("shingle", "place", "id", "shingles")
        wanted *= MORE
    whole = copies.withColumnRenamed("root", "r").join(roots.select(F.col("node").alias("r"), "root"), "r", "left").select("node", F.coalesce("root", "r").alias("root"))
    return roots.unionByName(whole).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with root, the least id of the component of their id."""
    return rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
