"""LM scoring by partial matching: a byte-context trie with escapes and symbol exclusion.

Training counts the paths of the trie, ORDER bytes of context and a symbol; shorter contexts are
sums of these. A symbol is coded in the longest known context; where it was not seen there, an
escape leads to the next shorter one, without the symbols of the longer (method C: a context with
t occurrences of d symbols escapes with d / (t + d)). Below all contexts unseen symbols are equal.
Byte 0xFF, which UTF-8 never holds, begins (ORDER times) and ends a text.

The trie grows with the corpus and stays in Spark, as packed arrays of sorted paths. To score, each
piece of documents asks for its distinct paths once. They are dealt by hash to buckets, where those
of all pieces become one list; their contexts' counts meet by the last two bytes of the context, of
which all longer contexts' counts there are sums; and the answers go back by bucket to the pieces.
So whatever a task holds is one piece, the distinct paths of one bucket or those of a share of the
two-byte contexts; a common path is a number in a piece's list, and the lists of pieces stream by.
The counts of contexts of one byte and none, at most 2**16 numbers, are broadcast.

Beside the model stands a base score, add-one unigrams of words, whose counts are kept and asked
for in the same way.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import ASCII_LOWER, binary, cut, lists, pieces, utf8

MARK = 0xFF
#: Bytes of context. Text bytes of a piece, and of all pieces for one bucket; least and most buckets, shares of two-byte contexts.
ORDER, PIECE, BUCKET_BYTES, BUCKETS, SHARES = 4, 4 << 20, 8 << 20, (16, 4096), (64, 1 << 16)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """paths (bucket, keys, counts) and words (bucket, keys, counts), packed by bucket; numbers of tokens, distinct tokens and texts."""

    paths: DataFrame
    words: DataFrame
    order: int
    buckets: int
    tokens: int
    distinct: int
    texts: int


def paths_of(at: np.ndarray, data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The trie path (order context bytes, symbol) of each byte and end of texts, as numbers, and the texts' offsets."""
    n = len(at) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    ends = at + (order + 1) * np.arange(n + 1)
    stream = np.full(int(ends[-1]), MARK, np.uint8)
    stream[np.arange(len(data)) + np.repeat((order + 1) * np.arange(n) + order, np.diff(at))] = data
    out = np.zeros(len(stream) - order, np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | stream[k : len(stream) - order + k]
    own = np.ones(len(out), bool)
    for k in range(1, order + 1):  # paths that run from one text into the next
        own[ends[1:-1] - k] = False
    return out[own], at + np.arange(n + 1)


def bucket_of(path: np.ndarray, buckets: int) -> np.ndarray:
    return ((path * SPREAD) >> np.uint64(33)).astype(np.int64) % buckets


def words_in(at: np.ndarray, data: np.ndarray) -> list[list[bytes]]:
    return [text.translate(ASCII_LOWER).split() for text in lists(at, data)]


def word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def shrink(numbers: np.ndarray) -> bytes:
    """Sorted numbers, packed."""
    import zstandard

    step = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(step.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def grow(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel())


def split(order: np.ndarray, bucket: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The indexes of each bucket, in order."""
    sorted_ = order[np.argsort(bucket[order], kind="stable")]
    return np.split(sorted_, np.searchsorted(bucket[sorted_], np.arange(1, buckets)))


def places_of(every: np.ndarray, path: np.ndarray) -> np.ndarray:
    """The index of each path in every (sorted, distinct), by a table of hashes: cheaper than a search for each."""
    bits = max(4, int(np.ceil(np.log2(4 * len(every) + 1))))
    slot = lambda x: (x * SPREAD) >> np.uint64(64 - bits)
    table = np.zeros(1 << bits, np.uint32)
    table[slot(every)] = np.arange(len(every), dtype=np.uint32)
    out = table[slot(path)]
    other = np.flatnonzero(every[out] != path)  # where two share a slot
    out[other] = np.searchsorted(every, path[other])
    return out


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(key), np.int64)
    np.add.at(out, at, np.concatenate(counts))
    return key, out


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """The model of all rows of docs. order: bytes of context, 2 to 7."""
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total, texts = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = int(np.clip(-(-total // BUCKET_BYTES), *BUCKETS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            at, data = utf8(piece.column("text"))
            path, n = np.unique(paths_of(at, data, order)[0], return_counts=True)
            rows = []
            for b, own in enumerate(split(np.arange(len(path)), bucket_of(path, buckets), buckets)):
                if len(own):
                    rows.append((True, b, shrink(path[own]), n[own].astype("<i8").tobytes()))
            words = Counter(chain.from_iterable(words_in(at, data)))
            names = list(words)
            for b, own in enumerate(split(np.arange(len(names)), word_buckets(names, buckets), buckets)):
                if len(own):
                    rows.append((False, b, b"\n".join(names[i] for i in own.tolist()), np.array([words[names[i]] for i in own.tolist()], "<i8").tobytes()))
            if rows:
                path_, b, keys, counts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(path_), pa.array(b, pa.int32()), binary(keys), binary(counts)], ["path", "bucket", "keys", "counts"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        words: Counter = Counter()
        bucket = None
        for batch in batches:
            bucket = batch.column("bucket")[:1]
            for path, keys, counts in zip(batch.column("path").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(counts, "<i8")
                if path:
                    held[0].append(grow(keys))
                    held[1].append(n)
                else:
                    for w, c in zip(keys.split(b"\n"), n.tolist(), strict=True):
                        words[w] += c
            if sum(map(len, held[0])) > 4_000_000:
                held = [[x] for x in merged(*held)]
        for path, (keys, counts) in ((True, merged(*held)), (False, (list(words), np.fromiter(words.values(), np.int64, len(words))))):
            if len(keys):
                packed = shrink(keys) if path else b"\n".join(keys)
                yield pa.RecordBatch.from_arrays([pa.array([path]), bucket, binary([packed]), binary([counts.astype("<i8").tobytes()]), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["path", "bucket", "keys", "counts", "n", "total"])

    sums = cut(own.mapInArrow(count, "path boolean, bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(sum_up, "path boolean, bucket int, keys binary, counts binary, n long, total long"))
    tokens, distinct = sums.where("NOT path").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Model(sums.where("path").drop("path", "n", "total"), sums.where("NOT path").drop("path", "n", "total"), order, buckets, tokens + texts, distinct + (texts > 0), texts)


def low_counts(model: Model) -> np.ndarray:
    """Counts of each symbol after each byte; only these leave Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                np.add.at(out, (grow(keys) & np.uint64(0xFFFF)).astype(np.int64), np.frombuffer(counts, "<i8"))
        (own,) = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(out[own])], ["pair", "n"])

    found = model.paths.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(256, 256)


def level_sums(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of paths and counts: distinct contexts (path without symbol), their occurrences and their numbers of symbols seen."""
    context = key >> np.uint64(8)
    new = np.concatenate([[True], context[1:] != context[:-1]])[: len(context)]
    at = np.cumsum(new) - 1
    n = int(new.sum())
    return context[new], np.bincount(at, count, n).astype(np.int64), np.bincount(at, count > 0, n).astype(np.int64)


def log_probabilities(path: np.ndarray, count: np.ndarray, order: int, one: np.ndarray) -> np.ndarray:
    """log10 probability of each of the sorted paths, whose two-byte contexts have all their paths here; one: see low_counts."""
    out, done = np.zeros(len(path)), np.zeros(len(path), bool)
    above = None  # of the next longer context: symbols seen, and their occurrences in this one, for each path
    key, n = path, count
    place = np.arange(len(path))  # of each path among the keys of this level
    log = lambda a, b: np.log10(np.where(a > 0, a, 1) / np.where(a > 0, b, 1))  # noqa: E731  an escape from nothing left is certain
    for k in range(order, -1, -1):
        if k >= 2:
            context, t, d = level_sums(key, n)
            at = np.searchsorted(context, key >> np.uint64(8))
            total, seen, own = t[at][place], d[at][place], n[place]
        else:
            table = one if k else one.sum(0)[None]
            cell = (path >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64) if k else np.zeros(len(path), np.int64)
            symbol = (path & np.uint64(0xFF)).astype(np.int64)
            total, seen, own = table.sum(1)[cell], (table > 0).sum(1)[cell], table[cell, symbol]
        free_total, free_seen = (total, seen) if above is None else (total - above[1], seen - above[0])
        known = total > 0
        hit = ~done & known & (own > 0)
        out[hit] += log(own[hit], (free_total + free_seen)[hit])
        leave = ~done & known & (own == 0)
        out[leave] += log(free_seen[leave], (free_total + free_seen)[leave])
        done |= hit
        if not k:
            break
        # the next shorter context: what its symbols that were seen here count there
        if k > 2:
            mask = np.uint64((1 << (8 * k)) - 1)
            short, back = np.unique(key & mask, return_inverse=True)
            m = np.bincount(back, n, len(short)).astype(np.int64)
            below = m[back]
            shut = np.bincount(at, np.where(n > 0, below, 0), len(context)).astype(np.int64)
            above = (seen, shut[at][place])
            key, n, place = short, m, back[place]
        elif k == 2:
            below = one[(key >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64), (key & np.uint64(0xFF)).astype(np.int64)]
            shut = np.bincount(at, np.where(n > 0, below, 0), len(context)).astype(np.int64)
            above = (seen, shut[at][place])
        else:
            above = (seen, ((one > 0) * one.sum(0)).sum(1)[cell])
    unseen = 256 - int((one.sum(0) > 0).sum())
    return np.where(done, out, out - np.log10(max(1, unseen)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    score: the model's log10 probability of the text's bytes and its end; a null text is an empty
    one. Tokens: words in ASCII lower case, parted by ASCII white space, then one end. Repeated rows
    stay; nothing learned makes all symbols and words equal.
    """
    order, buckets = model.order, model.buckets
    one = docs.sparkSession.sparkContext.broadcast(low_counts(model))
    shares = int(np.clip(2 * buckets, *SHARES))

    def distinct_of(at: np.ndarray, data: np.ndarray) -> tuple:
        """The paths and the words of a piece; the distinct ones, and which of them are in each bucket."""
        path, ends = paths_of(at, data, order)
        every, words = np.unique(path), words_in(at, data)
        names = list(dict.fromkeys(chain.from_iterable(words)))
        return path, ends, every, split(np.arange(len(every)), bucket_of(every, buckets), buckets), words, names, split(np.arange(len(names)), word_buckets(names, buckets), buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        first = TaskContext.get().partitionId() << 32
        for number, piece in enumerate(pieces(batches, limit=PIECE)):
            at, data = utf8(piece.column("text"))
            _, _, every, cells, _, names, shelves = distinct_of(at, data)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema) as out:
                out.write_batch(piece)
            rows = [(-1, zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes()), b"")]
            rows += [(b, shrink(every[own]) if len(own) else b"", b"\n".join(names[i] for i in shelf.tolist())) for b, (own, shelf) in enumerate(zip(cells, shelves, strict=True)) if len(own) or len(shelf)]
            for a in range(0, len(rows), 256):
                b, keys, words = zip(*rows[a : a + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([first + number] * len(b)), pa.array(b, pa.int32()), binary(keys), binary(words)], ["piece", "bucket", "keys", "words"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct paths of a bucket, asked for or learned, with counts, by share of the two-byte contexts."""
        held: list[list[np.ndarray]] = [[], []]
        bucket = 0
        for batch in batches:
            bucket = batch.column("bucket")[0].as_py()
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held[0].append(grow(keys))
                held[1].append(np.zeros(len(held[0][-1]), np.int64) if counts is None else np.frombuffer(counts, "<i8"))
            if sum(map(len, held[0])) > 4_000_000:
                held = [[x] for x in merged(*held)]
        path, n = merged(*held)
        share = bucket_of(path >> np.uint64(8) & np.uint64(0xFFFF), shares)
        rows = [(s, shrink(path[own]), n[own].astype("<i8").tobytes()) for s, own in enumerate(split(np.arange(len(path)), share, shares)) if len(own)]
        if rows:
            s, keys, counts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array([bucket] * len(s), pa.int32()), binary(keys), binary(counts)], ["share", "bucket", "keys", "counts"])

    def judge(group: pa.Table) -> pa.Table:
        keys = [grow(x) for x in group.column("keys").to_pylist()]
        counts = [np.frombuffer(x, "<i8") for x in group.column("counts").to_pylist()]
        path, n = merged(keys, counts)
        logs = log_probabilities(path, n, order, one.value).astype("<f4")
        return pa.table({"bucket": group.column("bucket"), "keys": group.column("keys"), "logs": binary([logs[np.searchsorted(path, k)].tobytes() for k in keys])})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each piece the answers to its paths and words of a bucket."""
        bucket, paths, logs, counts, table = None, [], [], {}, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    bucket, paths, logs, counts, table = r["bucket"], [], [], {}, None
                if r["kind"] == 0:
                    paths.append(grow(r["keys"]))
                    logs.append(np.frombuffer(r["logs"], "<f4"))
                    continue
                if r["kind"] == 1:
                    counts.update(zip(r["words"].split(b"\n"), np.frombuffer(r["logs"], "<i8").tolist(), strict=True))
                    continue
                if table is None and paths:
                    flat = np.concatenate(paths)
                    sorted_ = np.argsort(flat)
                    table = flat[sorted_], np.concatenate(logs)[sorted_]
                    paths, logs = [], []
                found = table[1][np.searchsorted(table[0], grow(r["keys"]))].tobytes() if r["keys"] else b""
                words = r["words"].split(b"\n") if r["words"] else []
                out.append((r["piece"], bucket, found, np.fromiter((counts.get(w, 0) for w in words), "<i8", len(words)).tobytes()))
            if out:
                p, b, found, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(b, pa.int32()), binary(found), binary(n)], ["piece", "bucket", "logs", "counts"])

    def add(group: pa.Table) -> pa.Table:
        import zstandard

        bucket = group.column("bucket").to_pylist()
        blobs, counted = group.column("logs").to_pylist(), group.column("counts").to_pylist()
        piece = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blobs[bucket.index(-1)])).read_all().combine_chunks()
        at, data = utf8(piece.column("text"))
        rows = piece.num_rows
        path, ends, every, cells, words, names, shelves = distinct_of(at, data)
        logs, c = np.zeros(len(every), np.float32), np.zeros(len(names), np.int64)
        for b, found, n in zip(bucket, blobs, counted, strict=True):
            if b >= 0:
                logs[cells[b]] = np.frombuffer(found, "<f4")
                c[shelves[b]] = np.frombuffer(n, "<i8")
        total = np.add.reduceat(logs[places_of(every, path)].astype(np.float64), ends[:-1])
        size = np.fromiter(map(len, words), np.int64, rows)
        code = dict(zip(names, range(len(names)), strict=True))
        owner, flat = np.repeat(np.arange(rows), size), np.fromiter(map(code.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
        unit = model_texts, model_tokens, model_distinct
        base = np.bincount(owner, np.log10(c[flat] + 1.0), rows) + np.log10(unit[0] + 1.0) - (size + 1) * np.log10(unit[1] + unit[2] + 1.0)
        known = np.bincount(owner, c[flat] > 0, rows).astype(np.int64) + (unit[0] > 0)
        return pa.table({"doc_id": piece.column("id"), "held_out": piece.column("held"), "n_tokens": size + 1, "n_known": known, "train_tokens": np.full(rows, unit[1]), "base_score": base, "score": total})

    model_texts, model_tokens, model_distinct = model.texts, model.tokens, model.distinct
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(held_col).alias("held"), F.col(text_col).alias("text"))
    asks = cut(own.mapInArrow(ask, "piece long, bucket int, keys binary, words binary"))
    wanted = asks.where("bucket >= 0")
    learned = model.paths.select("bucket", "keys", "counts")
    every = learned.unionByName(wanted.where("length(keys) > 0").select("bucket", "keys", F.lit(None).cast("binary").alias("counts")))
    spread = every.groupBy("bucket").applyInArrow(collect, "share int, bucket int, keys binary, counts binary")
    known = spread.groupBy("share").applyInArrow(judge, "bucket int, keys binary, logs binary")
    none = F.lit(None).cast("binary")
    meet = known.select(F.lit(0).alias("kind"), "bucket", "keys", none.alias("words"), "logs", F.lit(0).cast("long").alias("piece"))
    meet = meet.unionByName(model.words.select(F.lit(1).alias("kind"), "bucket", none.alias("keys"), F.col("keys").alias("words"), F.col("counts").alias("logs"), F.lit(0).cast("long").alias("piece")))
    meet = meet.unionByName(wanted.select(F.lit(2).alias("kind"), "bucket", "keys", "words", none.alias("logs"), "piece"))
    # what is known of a bucket comes first, so that the pieces' rows, of any number, pass by it
    answers = meet.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, "piece long, bucket int, logs binary, counts binary")
    return answers.unionByName(asks.where("bucket < 0").select("piece", "bucket", F.col("keys").alias("logs"), none.alias("counts"))).groupBy("piece").applyInArrow(
        add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
