"""Language identification with a string kernel.

Kernel: the blended-spectrum presence kernel. A text is the set of its byte n-grams of 1 to ``n``
bytes (A-Z lowered), each hashed into one of ``buckets`` bits; k(x, y) counts the common ones,
divided by the geometric mean of both sizes. Whole texts are read.

Classifier: landmarks, a few texts of each language, span the Nystroem feature space
k(x, landmarks) K^(-1/2); in it, one ridge regression for each language against the rest is solved
in closed form. Scoring multiplies a batch's bit matrix by the landmarks' and the result by the
weights: two batched matrix products.

Bounds: ``per_language`` training texts of a language at most, the first in a hash order of doc_id and
text, each of ``longest`` bytes at most, and ``rows`` training texts of all languages together (with
very many languages each has fewer; with more languages than that the fit raises an error, no language
is left out). Of these, ``landmarks`` divided by the number of languages are landmarks.

Edge cases: ``und`` with score 0 for null texts, texts without a letter, and where nothing could be
learned; rows with null lang or doc_id do not train; ties go to the language first in code-point
order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvigil.llm.common import SLICE_BYTES, hash_order, text_slices

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True

#: Texts whose bit matrix is in memory at once.
ROWS = 256


@dataclass
class LanguageModel:
    languages: list[str]
    n: int
    buckets: int
    landmarks: np.ndarray  # (landmarks, buckets) of 0 and 1
    weights: np.ndarray  # (landmarks, languages), with the inverse root of K inside

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(bits.sum(1), 1))[:, None]
        other = np.sqrt(np.maximum(self.landmarks.sum(1), 1))[None, :]
        return (bits @ self.landmarks.T) / own / other

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = [self.kernel(presence(data, offsets[a : a + ROWS + 1], self.n, self.buckets)) @ self.weights for a in range(0, len(offsets) - 1, ROWS)]
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def presence(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bit matrix of texts: which hashed n-grams of 1 to ``n`` bytes each has."""
    count = len(offsets) - 1
    bits = np.zeros(count * buckets, np.float32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for low in range(int(offsets[0]), int(offsets[-1]), SLICE_BYTES):  # a block sees the n - 1 bytes after it
        high = min(low + SLICE_BYTES, int(offsets[-1]))
        text = _LOWER[data[low : min(high + n - 1, int(offsets[-1]))]].astype(np.uint32)
        place = np.arange(low, high)
        owner = np.repeat(np.arange(count), np.diff(np.clip(offsets, low, high)))
        row, last = owner * buckets, offsets[owner + 1]
        code = text.copy()
        for k in range(1, n + 1):
            if k > 1:
                code = code[:-1] * np.uint32(257) + text[k - 1 :] if len(text) >= k else code[:0]
            m = min(len(code), high - low)
            spot = ((code[:m] + np.uint32(k * 0x9E3779)) * np.uint32(2654435761)) >> shift
            inside = place[:m] + k <= last[:m]
            bits[row[:m][inside] + spot[inside]] = 1
    return bits.reshape(count, buckets)


def language_sample(docs: DataFrame, train: Column, per_language: int, rows: int = 200_000, longest: int = 32_768) -> pa.Table:
    """(doc_id, text, lang) of at most ``per_language`` rows of each language and ``rows`` in all, of texts
    of ``longest`` bytes at most."""
    some = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(F.octet_length("text") <= longest).filter(train)
    keys = some.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), hash_order(F.col("doc_id"), F.col("text")).alias("turn"))
    counts = keys.groupBy("l").agg(F.approx_count_distinct("turn").alias("n"))
    n_languages = counts.count()
    if n_languages > rows:
        raise ValueError(f"{n_languages} languages, more than the {rows} rows of the sample")
    most = min(per_language, rows // max(1, n_languages))
    share = F.pmod(F.col("turn"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # thin by hash first, so that a language's window holds a few times its rows, not all
    thin = keys.join(F.broadcast(counts), "l")  # `rows` rows at most
    thin = thin.filter(share * F.col("n") < 3 * most + 30).select("id", "l", "turn").distinct()
    nth = F.row_number().over(Window.partitionBy("l").orderBy(share, "id", "turn"))
    picked = thin.withColumn("nth", nth).filter(F.col("nth") <= most).select("id", "l", "turn")
    texts = some.select(F.col("doc_id").alias("of"), F.col("text").alias("words"), F.col("lang").alias("tongue"), hash_order(F.col("doc_id"), F.col("text")).alias("of_turn"))
    found = texts.join(F.broadcast(picked), (F.col("of") == F.col("id")) & (F.col("tongue") == F.col("l")) & (F.col("of_turn") == F.col("turn")))
    # rows equal in all count once
    return found.groupBy("of", "tongue", "of_turn").agg(F.first("words").alias("text")).select(F.col("of").alias("doc_id"), "text", F.col("tongue").alias("lang")).toArrow()


def fit_language(sample: pa.Table, n: int = 3, buckets: int = 1 << 15, landmarks: int = 96, ridge: float = 0.05) -> LanguageModel:
    lang = np.array(sample.column("lang").to_pylist(), object)
    ids = np.array(sample.column("doc_id").to_pylist(), np.int64)
    names = sorted(set(lang.tolist()))
    if not names:
        return LanguageModel([], n, buckets, np.zeros((0, buckets), np.float32), np.zeros((0, 0), np.float32))
    spot = np.array([zlib.crc32(t.encode()) for t in sample.column("text").to_pylist()])
    order = np.lexsort((spot, ids, lang.astype(str)))
    texts = sample.column("text").take(pa.array(order))
    lang = lang[order]
    per = max(2, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(lang == x)[:per] for x in names])
    marks = np.concatenate([presence(d, o, n, buckets) for _, _, d, o in text_slices(texts.take(pa.array(chosen)), 200_000)])
    model = LanguageModel(names, n, buckets, marks, np.zeros((len(marks), len(names)), np.float32))
    k = model.kernel(marks).astype(np.float64)
    value, vector = np.linalg.eigh(k)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    rows = np.concatenate([model.kernel(presence(d, o, n, buckets)) for _, _, d, o in text_slices(texts, 200_000)]).astype(np.float64)
    features = rows @ root
    y = np.where(lang[:, None] == np.array(names, object)[None, :], 1.0, -1.0)
    share = np.array([(lang == x).sum() for x in lang], float)
    w = (1 / share)[:, None]  # languages count alike, however many rows they have
    gram = features.T @ (w * features) + ridge * np.eye(features.shape[1]) * len(names) / 100
    model.weights = (root @ np.linalg.solve(gram, features.T @ (w * y))).astype(np.float32)
    return model


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs(doc_id, text)``; the score is the winning
    regression, from -1..1 to 0..1."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                found = model.scores(data, offsets) if model.languages else None
                seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int32)])
                letters = seen[offsets[1:]] > seen[offsets[:-1]]
                for i in np.flatnonzero(~letters).tolist():
                    letters[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
                if found is None:
                    name, score = ["und"] * (high - low), np.zeros(high - low)
                else:
                    best = found.argmax(1)
                    name = [model.languages[b] if ok else "und" for b, ok in zip(best, letters)]
                    score = np.where(letters, np.clip((found.max(1).astype(np.float64) + 1) / 2, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(name), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
