"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword. For each bit a binary classifier (log odds of two- and three-byte
n-grams between the languages with and without the bit) gives a margin; decoding weighs the bits
by how well they part the training languages and takes the codeword with the least logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.common import pieces, utf8

#: Hash bins of n-grams (half for pairs, half for triples), and the weight of an unseen one.
BINS, SMOOTH = 8192, 0.5
#: N-grams beyond which a longer text makes a margin no firmer, and the factor from a mean log odds to a margin.
FIRM, SHARPNESS = 60, 6.0
#: A prediction is flagged as ambiguous if the second language gets a probability of at least this share of the first's.
AMBIGUOUS = 0.5
#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def ngram_counts(at: np.ndarray, data: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Counts (groups, BINS) of the n-grams of texts; text i is data[at[i]:at[i+1]], counted for group[i]."""
    half = np.uint32(BINS // 2 - 1)
    size = np.diff(at)
    owner = np.repeat(group, size).astype(np.int64) * BINS
    c = FOLD[data]
    out = np.zeros(groups * BINS, np.int64)
    last = np.repeat(at[1:], size)
    for n in (2, 3):
        if len(c) < n:
            continue
        h = c[: len(c) - n + 1] * np.uint32(0x9E3779B1)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[k : len(c) - n + 1 + k] * np.uint32(0xC2B2AE3D)
        h = ((h ^ (h >> np.uint32(13))) & half) + np.uint32(BINS // 2 * (n - 2))
        whole = np.arange(len(h)) + n <= last[: len(h)]
        out += np.bincount(owner[: len(h)][whole] + h[whole], minlength=len(out))
    return out.reshape(groups, BINS)


def code_matrix(languages: int) -> np.ndarray:
    """Rows of ±1 per language: all ways to part up to five languages, else random columns with far rows."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 5:
        cols = np.arange(1, 1 << (languages - 1))
        return np.where((cols[None, :] << 1) >> np.arange(languages)[:, None] & 1, 1.0, -1.0)
    bits = int(np.ceil(12 * np.log2(languages)))
    best, far = None, -1
    for seed in range(32):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (languages, bits))
        code = code[:, np.abs(code.sum(0)) < languages]
        apart = (code.shape[1] - code @ code.T) / 2
        least = (apart + np.eye(languages) * bits).min()
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, probability, and whether it is ambiguous, for rows of n-gram counts."""
        n = counts.sum(1, keepdims=True)
        margin = counts @ self.weights / np.maximum(n, 1) * SHARPNESS * np.sqrt(np.minimum(n, FIRM) / FIRM)
        loss = (np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code[None], -500, 500))) * self.trust).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        first = p.argmax(1)
        best = p[np.arange(len(p)), first]
        p[np.arange(len(p)), first] = 0
        return first, best, p.max(1) >= AMBIGUOUS * best


def model_of(counts: dict[str, np.ndarray]) -> Model:
    languages = sorted(counts)
    code = code_matrix(len(languages))
    share = np.array([(counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * BINS) for x in languages]).reshape(-1, BINS)
    weights = np.array([np.log(share[b > 0].mean(0) / share[b < 0].mean(0)) for b in code.T]).reshape(-1, BINS).T
    # a bit counts by the least margin with which it puts a training language on its own side
    side = (share @ weights) * code
    trust = np.maximum(side.min(0), 0) if code.shape[1] else np.zeros(0)
    trust = trust / trust.mean() if trust.sum() > 0 else np.ones(code.shape[1])
    return Model(languages, code, weights, trust)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts n-grams per language over all rows with text and language; only languages x BINS sums leave Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            lang, ngram, n = [], [], []
            for x, v in sums.items():
                (own,) = np.nonzero(v)
                lang += [x] * len(own)
                ngram.append(own)
                n.append(v[own])
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(ngram), pa.int32()), pa.array(np.concatenate(n), pa.int64())], ["lang", "ngram", "n"])

        for piece in pieces(batches, limit=1 << 20):
            code = piece.column("lang").dictionary_encode()
            found = code.dictionary.to_pylist()
            for x, v in zip(found, ngram_counts(*utf8(piece.column("text")), code.indices.to_numpy(), len(found)), strict=True):
                sums[x] = sums[x] + v if x in sums else v
            if len(sums) > 256:
                yield rows()
        if sums:
            yield rows()

    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    total = labelled.mapInArrow(count, "lang string, ngram int, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {x.lang: np.zeros(BINS) for x in labelled.select("lang").distinct().collect()}
    for x in total.toArrow().to_batches():
        for lang, ngram, n in zip(*(c.to_pylist() for c in x.columns), strict=True):
            counts[lang][ngram] = n
    return model_of(counts)


def has_letter(text: bytes) -> bool:
    return text.lower() != text.upper() or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (und: no text, no letter, or nothing learned), lang_score (0 to 1) and lang_ambiguous.

    Columns of these names are replaced. Only text is read for a prediction; of languages that fit equally
    well the first by name is taken. und has score 0 and is ambiguous. Repeated rows stay.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for piece in pieces(batches, text_col, 1 << 20):
            at, data = utf8(piece.column(text_col))
            rows = piece.num_rows
            raw = data.tobytes()
            known = np.array([bool(m.languages) and has_letter(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            if m.languages:
                best, score, flag = m.predict(ngram_counts(at, data, np.arange(rows), rows))
                names = np.array([*m.languages, "und"], object)[np.where(known, best, len(m.languages))]
            else:
                names, score, flag = np.full(rows, "und", object), np.zeros(rows), known
            out = [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(flag | ~known)]
            yield pa.RecordBatch.from_arrays([*piece.columns, *out], [*piece.schema.names, "lang_pred", "lang_score", "lang_ambiguous"])

    docs = docs.drop("lang_pred", "lang_score", "lang_ambiguous")
    ddl = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())])
    return docs.mapInArrow(run, ddl)
