"""Benchmark decontamination with spaced seeds.

Every window of SPAN words of a benchmark item is hashed under fixed masks that ignore some of its
positions, so chosen that, wherever as many words as are tolerated are substituted, one mask ignores
them all. Documents are read once: the hashes of their windows that pass a filter of the benchmark's
hashes are joined with these, and each hit is verified word by word. A piece of documents sends an
equal window once, with a list of where it stands, so that a passage in a third of all documents is
a row per piece; equal benchmark windows are one row with the number of their items. The benchmark
may be of any size: nothing of it but the filter, of bounded size, passes through the driver. A seed
that many different windows have on both sides, as where many items begin with one prompt, is joined
by lists of windows, not by pairs of rows.

A shorter item is one window of its own length, with fewer substitutions (see misses); an item of
fewer than LEAST words (the argument least) is too short to tell and matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import binary, cut, lists, pieces, utf8

#: Words of a window, and the fewest of an item that counts.
SPAN, LEAST = 12, 5
#: Bits of the filter for each benchmark hash, of which it sets two, and log2 of its least and largest size in bits (the largest takes 32 MB).
BITS_EACH, FILTER_BITS = 64, (16, 28)
#: All bytes but digits, lower-case letters and those of other characters become spaces.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
KEPT = 100_000
#: Windows of one seed in a row, on either side of the join.
PACK = 256
#: Pairs of windows compared at once.
PAIRS = 1 << 16
#: Columns that overlaps() gives.
RESULTS = ("doc_id", "item_id", "n_windows", "n_links", "first_word", "last_word", "equal_words")


class Hashes(dict):
    """XXH64 of words, kept for later texts of the task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > KEPT:
            self.clear()
        words = text.translate(WORDS).split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def misses(size: int) -> int:
    """Substituted words that a window of size words tolerates."""
    return 2 if size >= SPAN else 1 if size >= 8 else 0


def masks(size: int) -> list[np.ndarray]:
    """The kept positions of each mask: the window in twice as many parts as misses, all choices of half of them."""
    m = misses(size)
    if not m:
        return [np.arange(size)]
    part = np.arange(size) * 2 * m // size
    return [np.flatnonzero(np.isin(part, kept)) for kept in combinations(range(2 * m), m)]


def seed(words: np.ndarray, at: np.ndarray, size: int, mask: int) -> np.ndarray:
    """A hash of the kept positions of each window of size words."""
    n = len(words) - size + 1
    out = np.full(n, np.uint64((size * 64 + mask + 1) * 0x9E3779B97F4A7C15 % (1 << 64)), np.uint64)
    for k in at.tolist():
        out = (out ^ words[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def words_of(texts: list[bytes], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, the end of its text for each, and the texts' offsets."""
    each = [hashes.of(t) for t in texts]
    size = np.array([len(x) for x in each], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    return np.concatenate(each) if each else np.zeros(0, np.uint64), np.repeat(at[1:], size), at


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """size, words (their hashes, packed), item_id (the least), n_items: the distinct windows of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for piece in pieces(batches):
            items, held = [], []
            for item, text in zip(piece.column("item").to_pylist(), lists(*utf8(piece.column("text"))), strict=True):
                words = hashes.of(text)
                size = min(SPAN, len(words))
                for i in range(len(words) - size + 1 if size >= max(1, least) else 0):
                    items.append(item)
                    held.append(words[i : i + size].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), binary(held)], ["item", "words"])

    own = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL")
    each = own.mapInArrow(run, "item long, words binary").groupBy("words", "item").agg(F.lit(1).alias("n"))
    return each.groupBy("words").agg(F.min("item").alias("item_id"), F.sum("n").alias("n_items")).withColumn("size", (F.octet_length("words") / 8).cast("int"))


def benchmark_seeds(windows: DataFrame) -> DataFrame:
    """seed, words, item_id, n_items: each window under each of its masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("words").to_pylist()
            size = np.array([len(x) // 8 for x in raw])
            out = [np.zeros((0, 2), np.uint64)]
            for n in np.unique(size).tolist():
                (own,) = np.nonzero(size == n)
                flat = np.frombuffer(b"".join(raw[i] for i in own), "<u8")
                for m, at in enumerate(masks(n)):
                    out.append(np.stack([own.astype(np.uint64), seed(flat, at, n, m)[::n]], 1))
            out = np.concatenate(out)
            own = batch.take(pa.array(out[:, 0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 1].view(np.int64)), *(own.column(c) for c in ("words", "item_id", "n_items"))], ["seed", "words", "item_id", "n_items"])

    return windows.select("words", "item_id", "n_items").mapInArrow(run, "seed long, words binary, item_id long, n_items long")


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Two bits set for each hash that some seed has, from its high and its low bits (packed bits), and log2 of their number.

    Sums of 64 bits each are all that leaves Spark.
    """
    n = seeds.count()
    bits = int(np.clip(np.ceil(np.log2(max(1, n * BITS_EACH))), *FILTER_BITS))
    places = F.array(F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND((1 << bits) - 1))
    place = F.col("place")
    lanes = seeds.select(F.explode(places).alias("place")).select(F.shiftright(place, 6).alias("lane"), place.bitwiseAND(63).cast("int").alias("bit")).groupBy("lane").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("v"))
    found = lanes.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("lane").to_numpy()] = found.column("v").to_numpy()
    return out.view(np.uint64), bits


def passes(h: np.ndarray, lanes: np.ndarray, bits: int) -> np.ndarray:
    """Indexes of the hashes that have both their bits set."""
    bit = lambda place: lanes[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)
    (hit,) = np.nonzero(bit(h >> np.uint64(64 - bits)))
    return hit[bit(h[hit] & np.uint64((1 << bits) - 1)).astype(bool)]


def benchmark_packs(seeds: DataFrame) -> DataFrame:
    """seed, size, bench (words, item_id, n_items): the windows of one seed in lists of PACK. Rows of a seed stream by in order, none are held."""
    own = seeds.withColumn("size", (F.octet_length("words") / 8).cast("int"))
    place = F.row_number().over(Window.partitionBy("seed", "size").orderBy("words"))
    packs = own.withColumn("pack", F.floor((place - 1) / PACK)).groupBy("seed", "size", "pack")
    return packs.agg(F.collect_list(F.struct("words", "item_id", "n_items")).alias("bench")).drop("pack")


def document_seeds(docs: DataFrame, sizes: list[int], lanes: np.ndarray, bits: int) -> DataFrame:
    """seed, size, own (words, places): windows of docs (key, text) whose seed passes the filter, with where they stand.

    Different windows of a piece that share a seed go together, PACK at most in a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lanes, bits))
    ddl = "seed long, size int, own array<struct<words:binary,places:array<struct<key:string,first:long>>>>"
    kind = pa.list_(pa.struct([("words", pa.binary()), ("places", pa.list_(pa.struct([("key", pa.string()), ("first", pa.int64())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (lanes, bits), hashes = shared.value, Hashes()
        for piece in pieces(batches):
            words, ends, at = words_of(lists(*utf8(piece.column("text"))), hashes)
            found: dict[tuple[int, int], dict[bytes, list[int]]] = {}
            for size in sizes:
                for m, kept in enumerate(masks(size) if len(words) >= size else []):
                    h = seed(words, kept, size, m)
                    hit = passes(h, lanes, bits)
                    hit = hit[hit + size <= ends[hit]]
                    for i, s in zip(hit.tolist(), h[hit].view(np.int64).tolist(), strict=True):
                        found.setdefault((s, size), {}).setdefault(words[i : i + size].tobytes(), []).append(i)
            if not found:
                continue
            packs = [(s, size, some) for (s, size), windows in found.items() for some in batched(windows.items(), PACK)]
            held = [x for _, _, some in packs for x in some]
            first = np.concatenate([p for _, p in held])
            doc = np.searchsorted(at, first, side="right") - 1
            places = pa.StructArray.from_arrays([piece.column("key").take(pa.array(doc)), pa.array(first - at[doc], pa.int64())], fields=list(kind.value_type.field("places").type.value_type))
            places = pa.ListArray.from_arrays(np.cumsum([0, *[len(p) for _, p in held]]).astype(np.int32), places)
            windows = pa.StructArray.from_arrays([binary([w for w, _ in held]), places], fields=list(kind.value_type))
            own = pa.ListArray.from_arrays(np.cumsum([0, *[len(x) for _, _, x in packs]]).astype(np.int32), windows)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in packs], pa.int64()), pa.array([x[1] for x in packs], pa.int32()), own], ["seed", "size", "own"])

    return docs.mapInArrow(run, ddl)


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of windows within each row (size, own, bench) that differ in no more words than tolerated, with equal, the number of equal words."""
    for batch in batches:
        own, bench = batch.column("own"), batch.column("bench")
        (a_words, places), (b_words, item, n_items) = own.flatten().flatten(), bench.flatten().flatten()
        (a_at, a_raw), (b_at, b_raw) = utf8(a_words), utf8(b_words)
        a_flat, b_flat = (np.frombuffer(x.tobytes(), "<u8") for x in (a_raw, b_raw))
        m, n = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (own, bench))
        a_first, b_first = np.cumsum(m) - m, np.cumsum(n) - n
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            (rows,) = np.nonzero(sizes == size)
            block = np.cumsum(m[rows] * n[rows]) // PAIRS
            for some in np.split(rows, np.flatnonzero(np.diff(block)) + 1):
                pairs = m[some] * n[some]
                row, k = np.repeat(some, pairs), np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                p, q = a_first[row] + k // n[row], b_first[row] + k % n[row]
                same, x, y = np.zeros(len(p), np.int64), a_at[p] // 8, b_at[q] // 8
                for i in range(size):
                    same += a_flat[x + i] == b_flat[y + i]
                (good,) = np.nonzero(same >= size - misses(size))
                if len(good):
                    p, q = pa.array(p[good]), pa.array(q[good])
                    yield pa.RecordBatch.from_arrays([item.take(q), n_items.take(q), places.take(p), b_words.take(q), pa.array(np.full(len(good), size, np.int64)), pa.array(same[good])], ["item_id", "n_items", "places", "bench", "size", "equal"])


def candidates(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """size, own, bench: lists of windows that share a seed; where a seed is frequent on both sides a row stands for PACK x PACK pairs."""
    return found.join(cut(benchmark_packs(seeds)), ["seed", "size"]).select("size", "own", "bench")


def matches(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, least: int) -> DataFrame:
    """key, item_id, n_windows, n_links, first_word, last_word, equal_words of docs (key, text) that overlap the benchmark."""
    windows = cut(benchmark_windows(benchmark, item_col, item_text, least))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    seeds = cut(benchmark_seeds(windows))
    found = document_seeds(docs, sizes, *seed_filter(seeds))
    hits = candidates(found, seeds).mapInArrow(verified, "item_id long, n_items long, places array<struct<key:string,first:long>>, bench binary, size long, equal long")
    each = hits.select("item_id", "n_items", "bench", "size", "equal", F.explode("places").alias("p")).select("p.key", "p.first", "item_id", "n_items", "bench", "size", "equal")
    each = each.groupBy("key", "first", "size", "bench").agg(F.min("item_id").alias("item_id"), F.max("n_items").alias("n_items"), F.max("equal").alias("equal"))  # a pair of windows under several masks
    each = each.groupBy("key", "first", "size").agg(F.min("item_id").alias("item_id"), F.sum("n_items").alias("n_links"), F.max("equal").alias("equal"))
    return each.groupBy("key").agg(
        F.min("item_id").alias("item_id"), F.count("*").alias("n_windows"), F.sum("n_links").alias("n_links"), F.min("first").alias("first_word"), F.max(F.col("first") + F.col("size") - 1).alias("last_word"), F.max("equal").alias("equal_words")
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """A row per document that overlaps the benchmark: doc_id, item_id, n_windows, n_links, first_word, last_word, equal_words.

    item_id: the least item of a matched window; n_windows: the document's windows that match;
    n_links: with how many item windows in all (one that several items hold counts for each);
    first_word, last_word: of the windows, from 0; equal_words: the most equal words of one window.
    Null and empty texts, and a null item_id, match nothing. Rows of one doc_id count together, and
    a null doc_id is one document. Other columns are left out.
    """
    own = docs.select(F.col(id_col).cast("long").cast("string").alias("key"), F.col(text_col).alias("text"))
    return matches(own, benchmark, item_col, item_text, least).withColumn("doc_id", F.col("key").cast("long")).select(*RESULTS)


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", name: str = "contaminated", least: int = LEAST) -> DataFrame:
    """docs with a boolean, whether the row's text overlaps any item; a column of that name is replaced.

    Rows of one id are judged each by its own text, so are rows without an id.
    """
    key, row = "__trackloom_key", docs.drop(name)
    row = row.withColumn(key, F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    found = matches(row.select(F.col(key).alias("key"), F.col(text_col).alias("text")), benchmark, item_col, item_text, least).select(F.col("key").alias(key), F.lit(True).alias(name))
    return row.join(found, key, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(key)
