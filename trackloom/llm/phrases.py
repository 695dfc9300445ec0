"""Phrase collocations: words that stand together more often than their parts stand alone.

Passes over whole texts. The first count phrases in count-min sketches, words first, then pairs, then
longer ones, each only where the parts already sketched reach the least count: each task sends the cells
that it met, packed by shard of cells, and each shard's cells are summed over all tasks. A cell never
counts less than any of its phrases, and a phrase never more than its parts. The last pass counts exactly,
as text, the phrases whose cells all reach the least count and whose own parts do; so nothing frequent
is lost, and what collides in the sketch is told apart. A task sends these phrases sorted and packed, by
shard of their first two words. Candidates are then scored and subsumed in joins.

Cells grow with the corpus, a power of two near an eighth of its words for each row and length, up to
2**MAX_BITS: only their hot bits, 8 * 2**MAX_BITS bits (128 MB), are broadcast. Beyond that the sketch
lets more phrases through to the exact count; results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import lists, pieces, settle, small_batches, utf8, written

LENGTH, MIN_COUNT, TOP, SHARE = 4, 30, 2000, 80
#: Rows of the sketch; bits of the cells of a row and length; bits of a shard of cells.
ROWS, MIN_BITS, MAX_BITS, SHARD_BITS = 2, 12, 27, 18
#: Cells that a task holds before it packs them, and bytes of text that it parts at once.
HELD, TEXT = 12 << 20, 3 << 20
#: Phrases held before equal ones are summed, and bytes of text for each shard of phrases.
PHRASES, SHARD_TEXT = 1 << 20, 32 << 20
#: What parts pieces becomes a line feed, what parts words a space, and A-Z lower case.
PARTED = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """The words of some texts: as bytes, as numbers of the vocabulary, with their hash, piece and language."""

    words: list[bytes]
    codes: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    langs: list[str]

    def grams(self, n: int, shorter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """For each place a hash of the n words from there, and whether they are within a piece."""
        size = max(0, len(self.codes) - n + 1)
        last = self.hashes[n - 1 :][:size]
        h = mixed(last) if shorter is None else mixed(shorter[:size] * np.uint64(0xA0761D6478BD642F) + last)
        return h, self.piece[:size] == self.piece[n - 1 :][:size]


def cut_long(texts: list[bytes], langs: list[int], limit: int) -> Iterator[tuple[bytes, int]]:
    """Texts parted, those beyond the limit in runs of whole pieces, so that memory follows the limit."""
    for text, lang in zip(texts, langs, strict=True):
        text = text.translate(PARTED)
        while len(text) > limit and (at := text.find(b"\n", limit)) >= 0:
            yield text[:at], lang
            text = text[at + 1 :]
        yield text, lang


def words_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Words]:
    """The words of batches of (lang, text), some limit bytes of text at a time."""
    for part in pieces(batches, limit=limit):
        coded = part.column("lang").fill_null("und").dictionary_encode()
        names = coded.dictionary.to_pylist()
        bunch, size = [], 0
        for text, lang in cut_long(lists(*utf8(part.column("text"))), coded.indices.to_pylist(), limit):
            bunch.append((text, lang))
            size += len(text)
            if size >= limit:
                yield parsed(bunch, names)
                bunch, size = [], 0
        if bunch:
            yield parsed(bunch, names)


def parsed(texts: list[tuple[bytes, int]], langs: list[str]) -> Words:
    data = b"\n".join(t for t, _ in texts)
    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 32) | (raw == 10)
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])[: len(raw)])
    ends = np.cumsum([len(t) + 1 for t, _ in texts])
    lang = np.array([x for _, x in texts], np.int64)[np.searchsorted(ends, starts, side="right")]
    words = data.split()
    coded = pa.array(words, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    names = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in langs], np.uint64)
    hashes = mixed(known[codes] ^ names[lang]) if len(codes) else np.zeros(0, np.uint64)
    return Words(words, codes, hashes, np.cumsum(raw == 10)[starts], lang, langs)


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    if row:
        hashes = mixed(hashes + np.uint64(row))
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, a plane for each of their bytes, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def standing(words: Words, last: int, hot: list[np.ndarray], known: int, bits: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words the hashes of the phrases, and which of them may reach the least count.

    These are within a piece, and so are hot their cells and their parts, of up to known words.
    """
    h, alive = None, None
    for n in range(1, last + 1):
        h, now = words.grams(n, h)
        if alive is not None:
            now = now & alive[:-1] & alive[1:]
        for row in range(ROWS if n <= known else 0):
            cells = cells_of(h, row, bits)
            now = now & (hot[row * length + n - 1][cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
        alive = now
        yield n, h, alive


def hot_cells(docs: DataFrame, bits: int, least: int, length: int) -> np.ndarray:
    """The bits of the cells that reach the least count, [row * length + words - 1][cell / 8], of merged sketches.

    Phrases with a part whose cells don't reach it are in no cell.
    """
    out = np.zeros((ROWS * length, 1 << bits >> 3), np.uint8)
    for first, last in ((1, 1), (2, 2), (3, length)):
        if first <= min(last, length):
            add_hot(docs, bits, least, length, first, last, out)
    return out


def add_hot(docs: DataFrame, bits: int, least: int, length: int, first: int, last: int, out: np.ndarray) -> None:
    """Adds the bits for phrases of first to last words to out, which has those of fewer words."""
    shard = min(bits, SHARD_BITS)
    shared = docs.sparkSession.sparkContext.broadcast([x if k % length < first - 1 else x[:0] for k, x in enumerate(out)])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS * length)]

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for kind, parts in enumerate(held):
                cells, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else ([], [])
                parts.clear()
                if not len(cells):
                    continue
                edges = [0, *(np.flatnonzero(np.diff(cells >> np.uint32(shard))) + 1).tolist(), len(cells)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    out.append((kind, int(cells[a] >> np.uint32(shard)), packed(np.diff(cells[a:b], prepend=cells[a] & ~np.uint32((1 << shard) - 1))), packed(counts[a:b])))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "shard", "cells", "counts"])

        size = 0
        for words in words_of(batches, TEXT):
            for n, h, alive in standing(words, last, shared.value, first - 1, bits, length):
                if n < first:
                    continue
                h = h[alive]
                for row in range(ROWS):
                    held[row * length + n - 1].append(cells_of(h, row, bits))
                size += ROWS * len(h)
            if size >= HELD:
                yield from flush()
                size = 0
        yield from flush()
        settle()

    def merged(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << shard, np.int64)
        for part in parts:
            for cells, counts in zip(part.column("cells").to_pylist(), part.column("counts").to_pylist(), strict=True):
                total[np.cumsum(unpacked(cells), dtype=np.int64)] += unpacked(counts)
        hot = np.packbits(total >= least, bitorder="little").tobytes()
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([hot], pa.binary())], names=["kind", "shard", "hot"])

    sketches = docs.mapInArrow(sketched, "kind int, shard int, cells binary, counts binary")
    width = 1 << shard >> 3
    for r in sketches.groupBy("kind", "shard").applyInArrow(merged, "kind int, shard int, hot binary").toLocalIterator():
        out[r.kind, r.shard * width : (r.shard + 1) * width] = np.frombuffer(r.hot, np.uint8)
    shared.destroy()


def summed(parts: list[pa.Table]) -> pa.Table:
    """Rows of (shard, lang, phrase, f), those of equal phrases summed."""
    sums = pa.concat_tables(parts).group_by(["shard", "lang", "phrase"]).aggregate([("f", "sum")])
    return sums.rename_columns({"f_sum": "f"})


def sorted_packs(rows: pa.Table) -> pa.RecordBatch:
    """A row for each shard and language, with its phrases in order, one to a line, and their counts."""
    rows = rows.sort_by([(x, "ascending") for x in ("shard", "lang", "phrase")]).combine_chunks()
    shard, lang = rows.column("shard").to_numpy(), rows.column("lang").combine_chunks().dictionary_encode()
    f, phrase = rows.column("f").to_numpy(), rows.column("phrase").to_pylist()
    code = lang.indices.to_numpy()
    edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(code) != 0)) + 1).tolist(), len(f)]
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    columns = [
        pa.array(shard[edges[:-1]], pa.int32()),
        lang.take(pa.array(edges[:-1])).cast(pa.string()),
        pa.array([zstandard.compress(b"\n".join(phrase[a:b]), 3) for a, b in spans], pa.binary()),
        pa.array([packed(f[a:b]) for a, b in spans], pa.binary()),
    ]
    return pa.record_batch(columns, names=["shard", "lang", "phrases", "counts"])


def counts_of(docs: DataFrame, length: int = LENGTH, least: int = MIN_COUNT, bits: int | None = None) -> DataFrame:
    """lang, phrase, n_words, f: exact counts of all phrases of up to length words with f >= least, and with
    an empty phrase of no words the number of a language's words. docs: lang (null: und), text (null: empty).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if bits is None:
        bits = min(MAX_BITS, max(MIN_BITS, (size // 48).bit_length()))
    shards = size // SHARD_TEXT + 1
    shared = spark.sparkContext.broadcast(list(hot_cells(docs, bits, least, length)))

    def survivors(words: Words) -> Iterator[pa.Table]:
        """Counted by vocabulary numbers: a phrase is that of one word less, numbered, and its last word."""
        total = np.bincount(words.lang, minlength=len(words.langs))
        yield table(np.arange(len(total)), [b""] * len(total), total, words)
        number, start = words.lang, None
        for n, h, hot in standing(words, length, shared.value, length, bits, length):
            start = h if n <= 2 else start
            at = np.flatnonzero(hot)
            keys = number[at] << np.int64(32) | words.codes[at + n - 1]
            _, first, own, f = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            number = np.zeros(len(h), np.int64)
            number[at] = own
            at = at[first]
            yield table(words.lang[at], [b" ".join(words.words[i : i + n]) for i in at.tolist()], f, words, start[at])

    def table(lang: np.ndarray, phrase: list[bytes], f: np.ndarray, words: Words, start: np.ndarray | None = None) -> pa.Table:
        shard = np.zeros(len(f), np.int32) if start is None else ((start >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
        langs = pa.array(words.langs, pa.string()).take(pa.array(lang))
        return pa.table({"shard": shard, "lang": langs, "phrase": pa.array(phrase, pa.binary()), "f": f.astype(np.int64)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words in words_of(batches, TEXT):
            if not len(words.codes):
                continue
            for rows in survivors(words):
                held.append(rows)
                size += len(rows)
            if size >= PHRASES:
                yield sorted_packs(summed(held))
                held, size = [], 0
        if size:
            yield sorted_packs(summed(held))
        settle()

    def added(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, PHRASES
        for part in parts:
            for lang, phrases, counts in zip(*(part.column(x).to_pylist() for x in ("lang", "phrases", "counts")), strict=True):
                phrase = pa.array(zstandard.decompress(phrases).split(b"\n"), pa.binary())
                f = pa.array(unpacked(counts).astype(np.int64))
                held.append(pa.table({"shard": pa.repeat(0, len(f)), "lang": pa.repeat(lang, len(f)), "phrase": phrase, "f": f}))
                size += len(f)
                if size >= most:
                    held = [summed(held)]
                    size = len(held[0])
                    most = PHRASES + 2 * size
        rows = summed(held)
        rows = rows.filter((pc.field("f") >= least) | (pc.field("phrase") == b""))
        yield from rows.select(["lang", "phrase", "f"]).cast(pa.schema({"lang": pa.string(), "phrase": pa.string(), "f": pa.int64()})).to_batches()

    packs = docs.mapInArrow(counted, "shard int, lang string, phrases binary, counts binary")
    found = packs.groupBy("shard").applyInArrow(added, "lang string, phrase string, f long")
    out = written(found.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("n_words"), "f"), "phrase-counts")
    shared.destroy()
    return out


def collocations(counts: DataFrame, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut of counts_of()'s rows: each language's first phrases by score.

    A phrase is cut after each of its words but the last; the cut with the lowest
    floor(2000000 * a / (l + r)) counts, of equal ones the first. A phrase that stands in any longer one
    with at least share hundredths of its count is dropped. Ties go by a, then by the bytes of the phrase.
    """
    size = F.size("w")
    phrases = counts.where("n_words >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    text = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    spans = phrases.where(size > 2).withColumn("m", F.explode(F.sequence(F.lit(2), size - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    inside = spans.select("lang", text(F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR CAST(100 AS DECIMAL(3, 0)) * CAST(longer AS DECIMAL(19, 0)) < CAST(%d AS DECIMAL(5, 0)) * CAST(a AS DECIMAL(19, 0))" % share)
    parts = counts.where("n_words >= 1").select("lang", "phrase", "f")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("left"), text(F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.*")
    first = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    ranked = first(first(scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64))), "deal"))
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("cut"))
