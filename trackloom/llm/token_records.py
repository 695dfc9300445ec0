"""Token-id files: length-delimited binary records with masked checksums and an offset index.

A file is a header and records, all little-endian::

    header  8 bytes magic, uint32 shard, uint32 part, uint32 bytes of an id, uint32 records
    record  uint64 length, uint32 masked checksum of those 8 bytes,
            payload (int64 doc_id, uint8 null flag, ids), uint32 masked checksum of the payload
    end     one byte, the line end of the writer

The checksum is CRC-32 (zlib), masked by a rotation by 15 bits and an added constant, so that a
checksum of data that itself holds checksums stays useful. Files are written by Spark's own
committing writer (one row, one file), so a lost task leaves nothing behind and any file system
that Spark knows will do. Records stand in ascending (doc_id, text) order: files by shard, then part.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import lists, new_folder, pieces, utf8

MAGIC = b"TLREC\x00\x01\n"
HEADER = struct.Struct("<8sIIII")
MASK_DELTA = 0xA282EAD8
#: Words of a worker's cache of encodings; when it is full the half most used stays. It outlives a task, which starts with it.
CACHED_WORDS = 400_000
#: Words encoded by one call of the tokenizer.
WORDS_AT_ONCE = 256
_encoders: dict[str, WordEncoder] = {}
#: What a tokenizer may do to a text whose words are then encoded one by one.
NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
SPLITS = (
    {"type": "WhitespaceSplit"},
    {"type": "BertPreTokenizer"},
    {"type": "Whitespace"},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
)


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def parts_at_space(form: dict) -> bool:
    """Whether a tokenizer (its JSON) drops white space and joins nothing across it."""
    steps = lambda x, inner: x[inner] if x and x["type"] == "Sequence" else [x] if x else []
    first = steps(form.get("pre_tokenizer"), "pretokenizers")[:1]
    special = any(any(map(str.isspace, x["content"])) or x.get("lstrip") or x.get("rstrip") for x in form.get("added_tokens", []))
    return bool(first) and first[0] in SPLITS and not special and all(x in NORMALIZERS for x in steps(form.get("normalizer"), "normalizers"))


class WordEncoder(dict):
    """ids of texts, made from ids of their words.

    Words end at ASCII white space. Where the tokenizer is not known to part there too, as the
    word BPE does, a whole text counts as one word and is not kept.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = parts_at_space(json.load(f))
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.fresh: list[bytes] = []
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def shrink(self, most: int) -> None:
        """Keeps the words that were used most, the earlier of equals; counts are halved, so that old ones fade."""
        if len(self) <= most:
            return
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:most])
        words = list(self)
        self.clear()
        self.update((words[i], at) for at, i in enumerate(kept.tolist()))
        start, self.length, self.uses = self.start[kept], self.length[kept], self.uses[kept] // 2
        self.start = np.cumsum(self.length) - self.length
        self.flat = self.flat[np.repeat(start - self.start, self.length) + np.arange(int(self.length.sum()))]

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and how many each has.

        Where the tokenizer parts at white space, words are encoded many to a text, and an id belongs to
        the word in whose characters it starts.
        """
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        step = WORDS_AT_ONCE if self.by_word else 1
        for i in range(0, len(words), step):
            some = words[i : i + step]
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(done.ids, np.uint32)
            if step > 1:
                first = np.cumsum([0, *[len(w) + 1 for w in some]])
                at = np.fromiter((a for a, _ in done.offsets), np.int64, len(ids))
                lengths.append(np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(some)))
            else:
                lengths.append(np.array([len(ids)]))
            flat.append(ids)
        return np.concatenate(flat), np.concatenate(lengths)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by end_id, and the offsets of the texts."""
        if not self.by_word:
            self.reset()
        elif len(self) > CACHED_WORDS:
            self.shrink(CACHED_WORDS // 2)
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = text.split() if self.by_word else [text]
            counts[i] = len(found)
            words.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
        if self.fresh:
            flat, length = self.encode_words([w.decode("utf-8", "replace") for w in self.fresh])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length, self.flat = np.concatenate([self.length, length]), np.concatenate([self.flat, flat])
            self.fresh = []
        word = np.concatenate(words) if words else np.zeros(0, np.int64)
        uses = np.bincount(word, minlength=len(self))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        length = self.length[word]
        ends = np.cumsum(length)
        per_text = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[word] - (ends - length), length) + np.arange(total)]
        at = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.full(int(at[-1]), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[at[1:] - 1] = False
        out[keep] = ids
        return out, at


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def header(shard: int, part: int, width: int, records: int) -> bytes:
    return HEADER.pack(MAGIC, shard, part, width, records)


def record(doc_id: int | None, ids: bytes) -> bytes:
    payload = struct.pack("<q?", doc_id or 0, doc_id is None) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked_checksum(length)), payload, struct.pack("<I", masked_checksum(payload))])


def read_header(content: bytes) -> tuple:
    return HEADER.unpack_from(content)


def read_records(content: bytes) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(offset, doc_id, ids) of each record of a file; ValueError if a checksum or length is wrong."""
    magic, _, _, width, records = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a record file")
    at = HEADER.size
    for _ in range(records):
        head = content[at : at + 8]
        (length,) = struct.unpack("<Q", head)
        if struct.unpack_from("<I", content, at + 8)[0] != masked_checksum(head):
            raise ValueError(f"length checksum at {at}")
        payload = content[at + 12 : at + 12 + length]
        if len(payload) != length or struct.unpack_from("<I", content, at + 12 + length)[0] != masked_checksum(payload):
            raise ValueError(f"payload checksum at {at}")
        doc_id, null = struct.unpack_from("<q?", payload)
        yield at, None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype(np.uint32)
        at += length + 16
    if len(content) != at + 1:
        raise ValueError("bytes after the last record")


def read_record(content: bytes, offset: int) -> tuple[int | None, np.ndarray]:
    """One record at an offset of the index."""
    _, _, _, width, _ = HEADER.unpack_from(content)
    (length,) = struct.unpack_from("<Q", content, offset)
    payload = content[offset + 12 : offset + 12 + length]
    if struct.unpack_from("<I", content, offset + 12 + length)[0] != masked_checksum(payload):
        raise ValueError(f"payload checksum at {offset}")
    doc_id, null = struct.unpack_from("<q?", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype(np.uint32)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, file_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes record files of all docs under folder, in ascending order of id.

    A null or empty text is a record of end_id alone. Repeated rows and repeated ids stay, ordered
    by text; a null id comes first and is marked. Other columns are left out. No docs, no files.
    A file is cut after file_bytes, so that memory is bounded; a longer single record is a file.
    """

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, size, records = TaskContext.get().partitionId(), 0, 0, []
        encode = encoder(tokenizer_path)
        width = 2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4

        def file() -> pa.RecordBatch:
            whole = b"".join([header(shard, part, width, len(records)), *records])
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["file"])

        for piece in pieces(batches):
            ids, at = encode.encode(lists(*utf8(piece.column("text"))), end_id)
            ids = ids.astype(f"<u{width}")
            for doc_id, a, b in zip(piece.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                records.append(record(doc_id, ids[a:b].tobytes()))
                size += len(records[-1])
                if size >= file_bytes:
                    yield file()
                    part, size, records = part + 1, 0, []
        if records:
            yield file()

    (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
        .mapInArrow(frame, "file binary")
        .select(F.col("file").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .text(f"{folder}/records")
    )


def build_index(spark, folder: str) -> DataFrame:
    """Reads all record files back, verifies every checksum, and writes and returns the offset index.

    A row per record: shard, part, path, offset, doc_id, n_tokens, local_start (ids before it in
    its file), ids_crc32 (of the ids as little-endian uint32), file_tokens.
    """
    ddl = "shard long, part long, path string, offset long, doc_id long, n_tokens long, local_start long, ids_crc32 long, file_tokens long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                content = content.as_py()
                _, shard, part, _, _ = read_header(content)
                rows = [(at, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for at, doc_id, ids in read_records(content)]
                at, doc_id, n, crc = zip(*rows, strict=True)
                n = np.array(n, np.int64)
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * m, pa.int64()), pa.array([part] * m, pa.int64()), pa.array([path] * m), pa.array(at, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(n), pa.array(np.cumsum(n) - n), pa.array(crc, pa.int64()), pa.array(np.full(m, n.sum()))],
                    [x.split()[0] for x in ddl.split(", ")],
                )

    files = spark.read.format("binaryFile").load(f"{folder}/records").select("path", "content")
    files.mapInArrow(parse, ddl).write.parquet(f"{folder}/index")
    return spark.read.schema(ddl).parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with start, the ids of all records before each one.

    Files are summed within their shard, and one window runs over the shards (tasks of the writer), not records or files.
    """
    files = index.groupBy("shard", "part").agg(F.first("file_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = files.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", before(Window.orderBy("shard")).alias("shard_start"))
    files = files.select("shard", "part", before(Window.partitionBy("shard").orderBy("part")).alias("file_start"))
    return index.join(files.join(shards, "shard"), ["shard", "part"]).withColumn("start", F.col("shard_start") + F.col("file_start") + F.col("local_start"))


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes, reads back and indexes docs: doc_id, start, n_tokens, ids_crc32, path, offset."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-records")
    write_token_files(docs, folder, tokenizer_path, end_id, **columns)
    return with_starts(build_index(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32", "path", "offset")
