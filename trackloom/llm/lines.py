"""Line dedup over the whole corpus: levelled sorted runs of line hashes.

The index of lines is a list of runs: tables of (128-bit hash, documents, largest id), hashed into
buckets and sorted in them. Documents come in batches, those with the largest ids first. A batch sums
its lines by hash and merge-anti-joins the runs: a line that no run knows is fresh, and its largest
document, which is in this batch, is the one that keeps it; a line that is known already only adds to
a count. Both go into the batch's own run. FANOUT runs of a level are compacted to one of the next, so
that a batch meets few runs and a row is rewritten once a level. Runs have the buckets of a shuffle, so
a batch meets them where they lie; only its own lines are shuffled, summed first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.common import ASCII_LOWER, new_folder, pieces, remove, small_batches, written

#: Batches into which a corpus is dealt at once, and runs of a level that are compacted to one of the next.
BATCHES, FANOUT = 6, 3
#: A line counts from so many code points on and goes where so many documents hold it.
MIN_CHARS, MIN_DOCS = 40, 5
HASH = ["h1", "h2"]
#: Frequent lines that are broadcast (24 bytes each): 24 MB at most.
FEW = 1_000_000
#: Columns of the join of documents with the hashes of the lines that they lose.
LOST, LOST_ID = "_lost_lines", "_lost_doc_id"
BLANKS = " \t\n\x0b\x0c\r"


def line_hash(line: str, min_chars: int) -> bytes | None:
    """Of the line without blanks at its ends and with A-Z in lower case; None if that is too short."""
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode().translate(ASCII_LOWER)) if len(key) >= min_chars else None


def hashes_of(docs: DataFrame, batch: Column, min_chars: int = MIN_CHARS) -> DataFrame:
    """batch, doc_id, h1, h2: the distinct lines of each row of docs (doc_id, text) that are long enough."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found, sizes = [], []
            for text in part.column("text").to_pylist():
                own = {h for line in (text or "").split("\n") if (h := line_hash(line, min_chars))}
                found += own
                sizes.append(len(own))
            at = np.repeat(np.arange(part.num_rows), sizes)
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.record_batch([part.column("batch").take(pa.array(at)), part.column("doc_id").take(pa.array(at)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["batch", "doc_id", *HASH])

    return docs.select(batch.cast("int").alias("batch"), "doc_id", "text").mapInArrow(hashed, schema)


class Runs:
    """An index of lines that grows batch by batch; batches have falling ids.

    Its tables lie in the shared folder, so that a lost executor costs nothing but its tasks. close() removes them.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder, self.levels = new_folder(spark, "lines"), []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _run(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.select(*HASH, "n_docs", "last", "fresh").write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{self.folder}/{name}")

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def marked(self, lines: DataFrame) -> DataFrame:
        """h1, h2, n_docs, last, fresh (no run knows it) of lines (doc_id, h1, h2), distinct within a document. A row of the input is a document."""
        batch = lines.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        known = F.lit(False)
        for i, name in enumerate(self.names()):
            run = self.spark.table(name).where("fresh").select(*HASH, F.lit(True).alias(f"k{i}"))
            batch, known = batch.join(run, HASH, "left"), known | F.coalesce(F.col(f"k{i}"), F.lit(False))
        return batch.withColumn("fresh", ~known)

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch, all of whose ids are less than those before."""
        run, level = self._run(self.marked(lines)), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            run, level = self._run(self._merged(old)), level + 1
            for name in old:
                self._drop(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """One row a line: counts are summed, the id is that of the run where it was fresh, which is the largest."""
        # read as plain files: Spark 4.1.2 takes a union of bucketed tables for bucketed, and then doesn't bring equal buckets together
        rows = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[f"{self.folder}/{n}" for n in names])
        return rows.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"), F.max("fresh").alias("fresh"))

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """h1, h2, last of the lines in at least min_docs documents."""
        return self._merged(self.names()).where(F.col("n_docs") >= min_docs).select(*HASH, "last")

    def close(self) -> None:
        for name in self.names():
            self._drop(name)
        self.levels = []


def batches_of(docs: DataFrame, n: int) -> tuple[Column, int]:
    """A column that numbers n batches of about equal size by falling doc_id, from 0, and how many there are."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    batch = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        batch = F.when(F.col("doc_id") >= cuts[i], i).otherwise(batch)
    return batch, len(cuts) + 1


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, few: int = FEW) -> DataFrame:
    """docs (integer doc_id, text) with n_lines, n_dropped, kept: the text without the lines that larger ids hold too.

    Lines part at \\n; a null or empty text is one empty line. A line of at least min_chars code points
    (without blanks at its ends, A-Z in lower case) that at least min_docs rows hold goes from all of
    them but those of the largest doc_id. Rows that share an id count as rows and keep or lose a line
    together; a null id is less than all others. Columns of docs stay as they are, but n_lines,
    n_dropped and kept are replaced. No rows give none. Up to few frequent lines are broadcast to the
    documents; more are joined with them by line and then by document. Both give the same rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_lines", "n_dropped", "kept")
    batch, n = batches_of(docs, batches)
    lines = new_folder(spark, "line-hashes")
    hashes = hashes_of(docs, batch, min_chars)
    hashes.write.partitionBy("batch").parquet(lines)
    rows = spark.read.schema(hashes.schema).parquet(lines)
    runs = Runs(spark, fanout)
    for i in range(n):
        runs.add(rows.where(F.col("batch") == i).select("doc_id", *HASH))
    frequent = written(runs.frequent(min_docs), "frequent-lines")
    runs.close()
    if frequent.count() <= few:
        out = without(docs, docs.schema, min_chars, spark.sparkContext.broadcast(known_of(frequent)))
    else:
        lost = rows.join(frequent, HASH).where(~F.col("doc_id").eqNullSafe(F.col("last")))
        lost = written(lost.groupBy("doc_id").agg(F.collect_set(F.struct(*HASH)).alias(LOST)), "lost-lines")
        joined = docs.join(lost.withColumnRenamed("doc_id", LOST_ID), F.col("doc_id").eqNullSafe(F.col(LOST_ID)), "left").drop(LOST_ID)
        out = without(joined, docs.schema, min_chars)
    remove(spark, lines)
    return out


def known_of(frequent: DataFrame) -> tuple[bytes, list]:
    """The hashes of the frequent lines, one after another, and the ids that keep them."""
    rows = frequent.toArrow()
    return np.stack([rows.column(h).to_numpy() for h in HASH], axis=1).astype(np.int64).tobytes(), rows.column("last").to_pylist()


def without(docs: DataFrame, schema: T.StructType, min_chars: int, known: Broadcast | None = None) -> DataFrame:
    """docs with n_lines, n_dropped and kept. known: the frequent lines and who keeps them; None: docs have LOST, the hashes that each loses."""
    names = schema.names
    out = T.StructType([*schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    def joined(part: pa.RecordBatch) -> Iterator[set[bytes]]:
        lost = part.column(LOST)
        pairs, ends = lost.flatten(), np.concatenate([[0], np.cumsum(lost.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
        raw = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], axis=1).astype(np.int64).tobytes()
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield {raw[16 * j : 16 * j + 16] for j in range(a, b)}

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper = {}
        if known:
            raw, ids = known.value
            keeper = {raw[16 * j : 16 * j + 16]: x for j, x in enumerate(ids)}
        for part in pieces(batches):
            n_lines, n_dropped, kept = [], [], []
            for doc, text, lost in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), repeat(None) if known else joined(part), strict=False):
                all_lines = (text or "").split("\n")
                if known:
                    stay = [x for x in all_lines if (h := line_hash(x, min_chars)) not in keeper or keeper[h] == doc]
                else:
                    stay = [x for x in all_lines if line_hash(x, min_chars) not in lost] if lost else all_lines
                n_lines.append(len(all_lines))
                n_dropped.append(len(all_lines) - len(stay))
                kept.append("\n".join(stay))
            yield pa.record_batch([*[part.column(c) for c in names], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=out.names)

    return docs.mapInArrow(filtered, out)
