"""Exact substring dedup over a corpus, by suffix arrays of shards that meet by content.

Every window of LENGTH bytes belongs to an anchor, the gram of least hash in it. Equal windows have
equal anchors, so the windows of one anchor hash are judged in one shard. Anchors that stand in one
document alone (most of them) are left out first, by a count of their hashes; for the others their
context, the bytes of the anchor's windows, goes to the shard. A shard reads its contexts in a
stream and keeps distinct ones; it sorts their suffixes by induced sorting, computes permuted common
prefixes, and gives each window the least document in which it starts. (A context whose anchor has
no other context shares no window, so its least document is known without sorting.) A document loses
the bytes of windows that start in a smaller one.

Equal texts are one: the class is represented by its least doc_id, in which all windows of the
others start too. No group grows with a passage's number of copies: a piece of documents sends an
anchor or a context once, with a list of where it stands; what joins these again is a join that
Spark can split. The texts are shuffled once, by doc_id; all steps read that one exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import binary, join_hot, lists, pieces, utf8
from trackloom.llm.suffix import permuted_prefixes, suffix_array

#: Bytes of a gram; text bytes of a piece, and of a part of it that fits a core's cache; anchors wanted in a bucket, context bytes in a shard.
GRAM, PIECE, PART, BUCKET_ANCHORS, SHARD_BYTES = 20, 16 << 20, 1 << 16, 1_000_000, 3 << 20
SEPARATOR = b"\xff"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    word = np.lib.stride_tricks.as_strided(np.ascontiguousarray(data), (len(data) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h + word[8 : 8 + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h = (h + word[GRAM - 8 : GRAM - 8 + n]) * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


def anchors(at: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first window, last window) of each anchor's windows of length bytes; places count in data."""
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    h = gram_hashes(data)
    span = length - GRAM + 1
    n = len(data) - length + 1
    if n < 1:
        return none
    least = (h & ~np.uint64((1 << 26) - 1)) | np.arange(len(h), dtype=np.uint64)
    if len(data) > 1 << 26:
        parts = [anchors(np.array([0, b - a]), data[a:b], length) for a, b in zip(at[:-1], at[1:], strict=True)] if len(at) > 2 else [_long(data, length)]
        if len(at) > 2:
            return tuple(np.concatenate(x) for x in zip(*[(p[0], p[1] + i, p[2] + a, p[3] + a) for i, (a, p) in enumerate(zip(at[:-1], parts, strict=True))], strict=True))
        return parts[0]
    size = 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: n], least[span - size : span - size + n])
    anchor = (least & np.uint64((1 << 26) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    (whole,) = np.nonzero(np.arange(n) + length <= at[1:][text])
    if not len(whole):
        return none
    anchor, text = anchor[whole], text[whole]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(whole)]]) - 1
    return h[anchor[first]], text[first], whole[first], whole[last]


def _long(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of one text beyond the reach of 26-bit places: in parts that share all windows' bytes."""
    step, out = (1 << 26) - length, []
    for a in range(0, len(data) - length + 1, step):
        part = data[a : a + step + length - 1]
        h, t, f, g = anchors(np.array([0, len(part)]), part, length)
        out.append((h, t, f + a, g + a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchor_pieces(at: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchors of many texts, computed for about PART bytes at a time."""
    out, first = [], 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PART, side="right")) - 1)
        a, b = int(at[first]), int(at[last])
        h, t, f, g = anchors(at[first : last + 1] - a, data[a:b], length)
        out.append((h, t + first, f + a, g + a))
        first = last
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keys_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in the upper half, the hash's lower half in the lower one: what two documents must share."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def by_document(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct documents, how many values each has, and the values in their order."""
    order = np.argsort(doc, kind="stable")
    own, n = np.unique(doc, return_counts=True)
    return own, n, values[order]


def shared_anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """doc_id, keys: for each document the anchors that some other document may have too.

    A piece's anchors go to the bucket of their hash as packed arrays. One that stands in several
    documents of the piece is known to be shared: the bucket gets it once, without its documents.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in enumerate(pieces(batches, limit=PIECE)):
            piece = piece.filter(pc.and_(piece.column("doc_id").is_valid(), piece.column("text").is_valid()))
            h, t, _, _ = anchor_pieces(*utf8(piece.column("text")), length)
            ids = piece.column("doc_id").to_numpy()
            key = keys_of(h, buckets)
            order = np.lexsort((t, key))
            key, t = key[order], t[order]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (t[1:] != t[:-1])])[: len(key)]
            key, t = key[fresh], t[fresh]
            first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            count = np.diff(np.concatenate([np.flatnonzero(first), [len(key)]]))
            several = np.repeat(count > 1, count)
            rows: list[tuple[int, bool, bytes, bytes, bytes, bytes]] = []
            once_key, once_t, many = key[~several], t[~several], key[first & several]
            low, many_low = (once_key & np.uint64(0xFFFFFFFF)).astype("<u4"), (many & np.uint64(0xFFFFFFFF)).astype("<u4")
            once_at, many_at = once_key >> np.uint64(32), many >> np.uint64(32)
            occurring = np.union1d(once_at, many_at)
            cuts, many_cuts = (np.append(np.searchsorted(x, occurring), len(x)) for x in (once_at, many_at))
            for i, b in enumerate(occurring.tolist()):
                doc, n, values = by_document(once_t[cuts[i] : cuts[i + 1]], low[cuts[i] : cuts[i + 1]])
                rows.append((b, False, ids[doc].astype("<i8").tobytes(), n.astype("<u4").tobytes(), values.tobytes(), many_low[many_cuts[i] : many_cuts[i + 1]].tobytes()))
            doc, n, values = by_document(t[several], key[several])
            for a in range(0, len(doc), 1000):  # these only pass through a bucket, whichever it is
                end = np.cumsum(n)
                lo = int(end[a - 1]) if a else 0
                part = n[a : a + 1000]
                rows.append(((number + a // 1000) % buckets, True, ids[doc[a : a + 1000]].astype("<i8").tobytes(), part.astype("<u4").tobytes(), values[lo : lo + int(part.sum())].astype("<u8").tobytes(), b""))
            if rows:
                b, known, doc, n, values, multi = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(known), binary(doc), binary(n), binary(values), binary(multi)], ["bucket", "known", "docs", "counts", "values", "multi"])

    def meet(group: pa.Table) -> pa.Table:
        bucket = np.uint64(group.column("bucket")[0].as_py())
        known = np.array(group.column("known").to_pylist())
        doc, n, values, multi = (group.column(c).to_pylist() for c in ("docs", "counts", "values", "multi"))
        join = lambda blobs, keep, kind: np.frombuffer(b"".join(x for x, k in zip(blobs, keep, strict=True) if k), kind)
        low = join(values, ~known, "<u4")
        owner = np.repeat(join(doc, ~known, "<i8"), join(n, ~known, "<u4"))
        several = np.unique(join(multi, ~known, "<u4"))
        seen, count = np.unique(np.concatenate([low, several, several]), return_counts=True)
        good = np.isin(low, seen[count > 1])
        out_doc = np.concatenate([owner[good], np.repeat(join(doc, known, "<i8"), join(n, known, "<u4"))])
        out_key = np.concatenate([low[good].astype(np.uint64) | bucket << np.uint64(32), join(values, known, "<u8")])
        own, n, keys = by_document(out_doc, out_key)
        cuts = np.concatenate([[0], np.cumsum(8 * n)]).tolist()
        raw = keys.astype("<u8").tobytes()
        return pa.table({"doc_id": pa.array(own, pa.int64()), "keys": binary([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])})

    packed = docs.mapInArrow(pack, "bucket int, known boolean, docs binary, counts binary, values binary, multi binary")
    return packed.groupBy("bucket").applyInArrow(meet, "doc_id long, keys binary").groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))


def contexts_of(piece: pa.RecordBatch, length: int, buckets: int, shards: int) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(shard, context, doc_id, place of the context, tag of the anchor) of the anchors whose keys the rows hold."""
    at, data = utf8(piece.column("text"))
    raw = data.tobytes()
    ids, held = piece.column("doc_id").to_pylist(), piece.column("keys").to_pylist()
    h, t, f, g = anchor_pieces(at, data, length)
    key = keys_of(h, buckets)
    cuts = np.searchsorted(t, np.arange(piece.num_rows + 1))
    keep = np.zeros(len(h), bool)
    for i, keys in enumerate(held):
        if keys:
            a, b = cuts[i], cuts[i + 1]
            keep[a:b] = np.isin(key[a:b], np.frombuffer(b"".join(keys), "<u8"))
    shard = (h[keep] ^ (h[keep] >> np.uint64(32))) % np.uint64(shards)
    t, f, g, tag = t[keep], f[keep], g[keep], h[keep] & np.uint64(0xFFFFFFFF)
    for s, i, a, b, p, x in zip(shard.tolist(), t.tolist(), f.tolist(), (g + length).tolist(), (f - at[t]).tolist(), tag.tolist(), strict=True):
        yield s, raw[a:b], ids[i], p, x


def packed(contexts: list[bytes], lo: list[int], hi: list[int], tag: list[int]) -> bytes:
    """Contexts with their least and largest documents and tags, compressed."""
    import zstandard

    n = len(contexts)
    head = [np.array([n], "<u4"), np.fromiter(map(len, contexts), "<u4", n), np.array(tag, "<u4"), np.array(lo, "<i8"), np.array(hi, "<i8")]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*(x.tobytes() for x in head), *contexts]))


def unpacked(blob: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    size, tag = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(2, n)
    lo, hi = np.frombuffer(raw, "<i8", 2 * n, 4 + 8 * n).reshape(2, n)
    ends = (4 + 24 * n + np.cumsum(size, dtype=np.int64)).tolist()
    for a, b, *x in zip([4 + 24 * n, *ends], ends, lo.tolist(), hi.tolist(), tag.tolist(), strict=False):
        yield raw[a:b], *x


def first_documents(contexts: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each context (all bytes but 0xFE and 0xFF) the least document of any equal window, and offsets."""
    size = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(SEPARATOR.join([*contexts, b""]), np.uint8)
    text = np.concatenate([np.where(text == 0xFF, 0xFF, text + 1), [0]]).astype(np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    windows = size - length + 1
    at = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(len(size)), windows)
    place = begin[owner] + np.arange(at[-1]) - at[owner]
    sa = suffix_array(text)
    prefix = permuted_prefixes(text, sa)[sa]
    group = np.empty(len(sa), np.int64)
    group[sa] = np.cumsum(prefix < length)
    own = group[place]
    best = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, own, least[owner])
    return best[own], at


def copies_of(docs: DataFrame) -> DataFrame:
    """doc_id, copied: digests of the document's texts that stand in a smaller doc_id as well."""
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "digest")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return join_hot(own, first, "digest").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("copied"))


def repeated_spans(docs: DataFrame, length: int = 50, total: int | None = None) -> DataFrame:
    """doc_id, starts, ends: byte ranges of windows that start in a smaller doc_id too.

    docs: doc_id, text, copy; a row with copy is left out, its windows are those of another row.
    """
    if total is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-total // (15 * BUCKET_ANCHORS)))
    shards = max(64, -(-total // SHARD_BYTES))
    docs = docs.where("NOT copy").select("doc_id", "text")
    held = docs.join(shared_anchors(docs, length, buckets), "doc_id", "left")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            seen: dict[int, dict[bytes, list[int]]] = {}
            for s, c, doc, _, tag in contexts_of(piece, length, buckets, shards):
                x = seen.setdefault(s, {}).setdefault(c, [doc, doc, tag])
                if doc < x[0]:
                    x[0] = doc
                elif doc > x[1]:
                    x[1] = doc
            if seen:
                blobs = [packed(list(x), *zip(*x.values(), strict=True)) for x in seen.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), binary(blobs)], ["shard", "contexts"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for piece in pieces(batches, limit=PIECE):
            seen: dict[tuple[int, bytes], list[int]] = {}
            for s, c, doc, p, _ in contexts_of(piece, length, buckets, shards):
                seen.setdefault((s, c), []).extend((doc, p))
            if seen:
                keys = [digest(c) for _, c in seen]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen], pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)), binary([np.array(v, "<i8").tobytes() for v in seen.values()])], ["shard", "context", "places"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shard, seen = None, {}
        for batch in batches:
            shard = batch.column("shard")[:1]
            for blob in batch.column("contexts"):
                for c, lo, hi, tag in unpacked(blob.as_py()):
                    x = seen.setdefault(c, [lo, hi, tag])
                    if lo < x[0]:
                        x[0] = lo
                    if hi > x[1]:
                        x[1] = hi
        contexts = list(seen)
        lo, hi, tag = np.array(list(seen.values()), np.int64).T
        _, kind, count = np.unique(tag, return_inverse=True, return_counts=True)
        met = count[kind] > 1
        alone, met = np.flatnonzero(~met & (lo < hi)), np.flatnonzero(met)
        keep, held = alone.tolist(), [np.full(len(contexts[i]) - length + 1, lo[i], "<i8").tobytes() for i in alone]
        if len(met):
            first, at = first_documents([contexts[i] for i in met], lo[met], length)
            raw, cuts = first.astype("<i8").tobytes(), (8 * at).tolist()
            for j in np.flatnonzero(np.minimum.reduceat(first, at[:-1]) < hi[met]):
                keep.append(met[j])
                held.append(raw[cuts[j] : cuts[j + 1]])
        keys = np.array([xxhash.xxh3_64_intdigest(contexts[i]) for i in keep], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.repeat(shard[0], len(keep)), pa.array(keys), binary(held)], ["shard", "context", "first"])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                fs, ps = part.column("first").to_pylist(), part.column("places").to_pylist()
                first, places = np.frombuffer(b"".join(fs), "<i8"), np.frombuffer(b"".join(ps), "<i8").reshape(-1, 2)
                nf, np_ = np.array([len(x) // 8 for x in fs]), np.array([len(x) // 16 for x in ps])
                row = np.repeat(np.arange(len(fs)), np_)
                wide = nf[row]
                which = np.repeat(np.arange(len(places)), wide)
                off = np.arange(len(which)) - np.repeat(np.cumsum(wide) - wide, wide)
                hit = first[(np.cumsum(nf) - nf)[row][which] + off] < places[which, 0]
                which, off = which[hit], off[hit]
                new = np.concatenate([[True], (which[1:] != which[:-1]) | (off[1:] != off[:-1] + 1)])[: len(which)]
                lo = np.flatnonzero(new)
                hi = np.concatenate([lo[1:], [len(which)]])[: len(lo)] - 1
                if len(lo):
                    yield pa.RecordBatch.from_arrays([pa.array(places[which[lo], 0]), pa.array(places[which[lo], 1] + off[lo]), pa.array(places[which[hi], 1] + off[hi] + length)], ["doc_id", "start", "end"])

    judged = held.mapInArrow(collect, "shard int, contexts binary").groupBy("shard").applyInArrow(judge, "shard int, context long, first binary")
    spans = held.mapInArrow(place, "shard int, context long, places binary").join(judged, ["shard", "context"]).mapInArrow(cover, "doc_id long, start long, end long")
    return spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end), kept (the bytes left), per row.

    A byte goes if a window of length bytes covers it that also starts in a row with a smaller
    doc_id. Rows of one doc_id do not take from each other, and each loses what any of them would;
    a null id neither gives nor loses. A null text is empty; matches never cross documents.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)).alias("digest"))
    copy = F.coalesce(F.array_contains("copied", F.col("digest")), F.lit(False))
    own = own.join(copies_of(own), "doc_id", "left").select("doc_id", "text", copy.alias("copy"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for piece in pieces(batches):
            rows = []
            for doc, text, copy, starts, ends in zip(piece.column("doc_id").to_pylist(), lists(*utf8(piece.column("text"))), piece.column("copy").to_pylist(), piece.column("starts").to_pylist(), piece.column("ends").to_pylist(), strict=True):
                if copy and len(text) >= length:
                    starts, ends = [0], [len(text)]
                runs = [(a, min(b, len(text))) for a, b in merged(starts or [], ends or []) if a < len(text)]
                last, parts = 0, []
                for a, b in runs:
                    parts.append(text[last:a])
                    last = b
                left = b"".join([*parts, text[last:]])
                rows.append((doc, len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in runs], left))
            columns = zip(*rows, strict=True)
            kinds = [*[pa.int64()] * 4, pa.string(), kind, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return own.join(repeated_spans(own, length), "doc_id", "left").mapInArrow(remove, ddl)
