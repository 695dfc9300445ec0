"""Conversation prefix trie: its nodes as intervals of a preorder.

A node is a distinct sequence of first turns, known by its depth and two 64-bit sums (exclusive or) of
the hashes of its turns with their depths. So the nodes along a conversation are running totals, and a
conversation of any length is dealt to many tasks.

Preorder without comparing sequences: of a node's children that with most members is heavy, the others
are light, and a path has at most log2(conversations) light nodes. A node's rank is the order of its
light ancestors, each by (depth, hash), and then its own depth. A chain (a light node and the heavy ones
below it) ends where the subtrees of all its nodes end. Leaves and savings of a subtree are differences of
sums that run over the ranked nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import ordered, running, written

NODE, PARENT = ["depth", "x1", "x2"], ["up", "p1", "p2"]
#: The SHA-256 of nothing.
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(messages: DataFrame) -> DataFrame:
    """conv, place (from 0), t1, t2 (hashes of role and text), chars, seq: the messages in order of turn (null first), role and text."""
    own = messages.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).where("conv IS NOT NULL")
    hashed = own.withColumns({"t1": F.xxhash64(F.lit(1), "role", "text"), "t2": F.xxhash64(F.lit(2), "text", "role"), "chars": F.length("text").cast("long")})
    rows = ordered(hashed, ["conv", "turn", "role", "text"], ["conv", "t1", "t2", "chars"], "turns")
    return written(running(rows, ["conv"], {"place": F.lit(1)}).withColumn("place", F.col("place") - 1), "placed-turns")


def element(seed: int, depth: Column) -> Column:
    """A hash of a turn at a depth."""
    return F.xxhash64(F.lit(seed), F.col("t1"), F.col("t2"), depth.cast("long"))


def shared_heads(conv: Column) -> tuple[Column, Column]:
    """The conversation whose first turns a conversation takes over, and how many at most."""
    return conv - conv % 100, (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def paths_of(turns: DataFrame, heads: tuple[Column, Column] | None) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, x1, x2, p1, p2, chars): a node for each turn of each rebuilt conversation; (conv, size): its turns.

    heads: the base of a conversation and the number of its turns to take over, as columns of conv; None: all stay as they are.
    """
    base, most = heads or (F.col("conv"), F.lit(0))
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = sizes.select("conv", "own", base.alias("base"), most.cast("long").alias("most"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left").withColumn("taken", F.least("most", F.coalesce("there", F.lit(0))))

    wanted = convs.groupBy("base").agg(F.max("taken").alias("wanted")).where("wanted > 0")
    first = turns.withColumnRenamed("conv", "base").join(wanted, "base").where("place < wanted").withColumn("depth", F.col("place") + 1)
    first = first.withColumns({"g1": element(3, F.col("depth")), "g2": element(4, F.col("depth"))})
    first = running(first, ["base"], {"x1": F.col("g1"), "x2": F.col("g2")}, F.bit_xor, Column.bitwiseXOR)
    first = written(first.select("base", *NODE, F.col("x1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("g2")).alias("p2"), "chars"), "heads")
    last = first.select("base", F.col("depth").alias("taken"), F.col("x1").alias("b1"), F.col("x2").alias("b2"))
    convs = written(convs.join(last, ["base", "taken"], "left").select("conv", "base", "most", "taken", "own", F.coalesce("b1", F.lit(0)).alias("b1"), F.coalesce("b2", F.lit(0)).alias("b2")), "conversations")

    above = convs.where("taken > 0").select("conv", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("depth")).join(first, ["base", "depth"])
    rest = turns.join(convs, "conv").where("place >= most").withColumn("depth", F.col("taken") + F.col("place") - F.col("most") + 1)
    rest = rest.withColumns({"g1": element(3, F.col("depth")), "g2": element(4, F.col("depth"))})
    rest = running(rest, ["conv"], {"x1": F.col("g1"), "x2": F.col("g2")}, F.bit_xor, Column.bitwiseXOR)
    rest = rest.withColumns({f"x{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    rest = rest.withColumns({f"p{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"g{i}")) for i in (1, 2)})
    columns = ["conv", *NODE, "p1", "p2", "chars"]
    size = (F.col("taken") + F.greatest(F.col("own") - F.col("most"), F.lit(0))).alias("size")
    return written(above.select(*columns).unionByName(rest.select(*columns)), "paths"), convs.select("conv", size)


def tree_of(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """NODE, conv_id, parent_conv_id, n_convs, chars, n_children, light: a row per node, the root among them."""
    root = sizes.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    nodes = paths.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"))
    nodes = nodes.withColumn("up", F.col("depth") - 1)
    nodes = written(nodes.unionByName(root.select(*[zero.alias(c) for c in (*NODE, "p1", "p2", "chars")], "conv_id", "n_convs", F.lit(-1).cast("long").alias("up"))), "nodes")
    kids = nodes.where("depth > 0").groupBy(*[F.col(p).alias(n) for p, n in zip(PARENT, NODE, strict=True)]).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "x1", "x2")).alias("heavy"))
    nodes = written(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes-and-children")
    parents = nodes.where("n_children > 0").select(*[F.col(n).alias(p) for n, p in zip(NODE, PARENT, strict=True)], F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("first"))
    light = ~((F.col("first.x1") == F.col("x1")) & (F.col("first.x2") == F.col("x2")))
    return written(nodes.join(parents, PARENT, "left").select(*NODE, "conv_id", "parent_conv_id", "n_convs", "chars", "n_children", F.coalesce(light, F.lit(False)).alias("light")), "tree")


def ranked(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """tree with position (from 0, in preorder), end (of the last node of its subtree), n_leaves and saved_tokens."""
    above = paths.join(tree.where("light").select(*NODE), NODE).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*NODE))).alias("above"))
    nodes = tree.join(above.withColumnRenamed("conv", "conv_id"), "conv_id", "left")
    chain = F.filter(F.coalesce("above", F.array().cast("array<struct<depth:bigint,x1:bigint,x2:bigint>>")), lambda a: a["depth"] <= F.col("depth"))
    nodes = nodes.withColumn("above", chain)
    # at one depth what turns off stands before what stays in the chain
    step = lambda depth, stays, x1, x2: F.struct(depth.alias("depth"), F.lit(stays).alias("stays"), x1.alias("x1"), x2.alias("x2"))
    zero = F.lit(0).cast("long")
    key = F.concat(F.transform("above", lambda a: step(a["depth"], 0, a["x1"], a["x2"])), F.array(step(F.col("depth"), 1, zero, zero)))
    rows = ordered(nodes.withColumn("key", key), ["key"], [*tree.columns, "above"], "preorder")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    rows = written(running(rows, [], {"position": F.lit(1), "leaves": leaf, "savings": saved}).withColumn("position", F.col("position") - 1), "ranked")
    top = F.struct(*[zero.alias(c) for c in NODE])
    chains = rows.select(F.explode(F.concat(F.array(top), F.col("above"))).alias("chain"), "position", "leaves", "savings")
    ends = chains.groupBy("chain").agg(F.max("position").alias("end"), F.max("leaves").alias("all_leaves"), F.max("savings").alias("all_savings"))
    out = rows.withColumn("chain", F.when(F.size("above") > 0, F.element_at("above", -1)).otherwise(top)).join(ends, "chain")
    return out.select(*tree.columns, "position", "end", (F.col("all_leaves") - F.col("leaves") + leaf).alias("n_leaves"), (F.col("all_savings") - F.col("savings") + saved).alias("saved_tokens"))


def ends_of(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """NODE, n_ends, ends_sha256: of the ids that end at a node, ascending. The ids of a node come in the pieces of ranges, one after another."""
    zero = F.lit(0).cast("long")
    ends = paths.select("conv", *NODE).join(sizes, "conv").where("depth = size").select("conv", *NODE).unionByName(sizes.where("size = 0").select("conv", *[zero.alias(c) for c in NODE]))
    rows = ordered(ends, [*NODE, "conv"], [*NODE, "conv"], "ends").withColumn("range", F.shiftright("seq", 33))
    parts = rows.groupBy(*NODE, "range").agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    parts = parts.select(*NODE, "range", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, digest = None, 0, hashlib.sha256()
        for batch in batches:
            out = []
            for *own, size, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "n", "ids")], strict=True):
                if own == node:
                    digest.update(b",")
                else:
                    if node:
                        out.append((*node, n, digest.hexdigest()))
                    node, n, digest = own, 0, hashlib.sha256()
                digest.update(ids.encode())
                n += size
            yield rows_of(out)
        yield rows_of([(*node, n, digest.hexdigest())] if node else [])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[*NODE, "n_ends", "ends_sha256"])

    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "range").drop("range").mapInArrow(hashed, "depth long, x1 long, x2 long, n_ends long, ends_sha256 string")


def prefix_trie(messages: DataFrame, heads: tuple[Column, Column] | None = None) -> DataFrame:
    """A row per node of the trie of messages (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, n_ends, position, end.

    Turns stand in order of turn, nulls first, then role, then text; null role or text is empty, a repeated
    row is a turn of its own, and a null conv_id takes no part. heads: what paths_of() takes over, or None.
    position is the node's place in preorder, end that of the last node of its subtree. saved_tokens counts
    code points of last texts that members after the first repeat. Other columns are left out; no
    conversations give no row, not even the root.
    """
    turns = turns_of(messages)
    paths, sizes = paths_of(turns, heads)
    tree = tree_of(paths, sizes)
    out = ranked(tree, paths).join(ends_of(paths, sizes), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), F.coalesce("n_ends", F.lit(0)).cast("long").alias("n_ends"), "position", "end"
    )
