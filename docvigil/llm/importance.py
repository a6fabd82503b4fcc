"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Features of a text are its words (A-Z lowered) and pairs of neighbouring words, hashed into
``buckets``. The raw model counts the features of every whole text. The target model counts those
of texts labelled as good: ``targets`` rows at most, the first in a hash order of doc_id. A text's
log weight is the sum of log p_target - log p_raw over its features. Adding Gumbel noise, drawn
from a hash of id and text, and keeping the k largest samples k rows without replacement in
proportion to their weights; the k-th largest is found exactly with histograms that Spark counts.

By default k is the share of good rows among the labelled ones, of all rows.

Edge cases: null and empty texts have weight 0 (log 1); rows that tie with the k-th stay; labels
repeated for a doc_id count as good if any is; without usable labels all weights are equal and every
row stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvigil.llm.common import SPACE, Words, hash_order, kth_largest, materialize, mix, segment_sum, text_slices

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of a slice's words, of the pairs that start at them (0 where a text ends), and where
    each text's words begin."""
    words = Words(_LOWER[data], offsets, SPACE)
    h = words.hashes()
    one = (h % np.uint64(buckets)).astype(np.int64)
    two = np.full(len(h), -1, np.int64)
    if len(h) > 1:
        two[:-1] = (mix(h[:-1] * np.uint64(3) + h[1:], 9) % np.uint64(buckets)).astype(np.int64)
    ends = words.first[1:] - 1
    two[ends[words.count > 0]] = -1
    return one, two, words.first


def feature_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): the features of all texts, summed in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                one, two, _ = features(data, offsets, buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two[two >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratio(raw: DataFrame, target: DataFrame, buckets: int, smoothing: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket; ``buckets`` numbers whatever the size of the input."""

    def dense(df: DataFrame) -> np.ndarray:
        out = np.full(buckets, smoothing)
        for r in df.collect():
            out[r["bucket"]] += r["n"]
        return np.log(out / out.sum())

    return dense(target) - dense(raw)


def importance_sample(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 15, targets: int = 20_000, keep: float | None = None) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) of each row of ``docs(doc_id, text)``; ``labels(doc_id,
    quality)`` names the target rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    n_marked, n_good = marked.agg(F.count("id"), F.coalesce(F.sum(F.when(F.col("quality") == 1, 1)), F.lit(0))).first()
    good = marked.filter("quality = 1").orderBy(hash_order(F.col("id")), "id").limit(targets).select("id")
    if n_good:
        table = log_ratio(feature_counts(rows, buckets), feature_counts(rows.join(F.broadcast(good), rows["doc_id"] == good["id"], "left_semi"), buckets), buckets)
    else:
        table = np.zeros(buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                one, two, first = features(data, offsets, buckets)
                found = segment_sum(table[one] + np.where(two >= 0, table[two], 0.0), first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), batch.column("u").slice(low, high - low), pa.array(found)], names=["doc_id", "u", "log_weight"])

    keyed = rows.withColumn("u", (F.pmod(F.xxhash64("doc_id", "text", F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52)))
    scored = keyed.mapInArrow(weigh, "doc_id long, u double, log_weight double")
    scored = materialize(scored.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log("u"))).alias("gumbel_key")), "weights")
    share = keep if keep is not None else (n_good / n_marked if n_good else 1.0)
    least, _ = kth_largest(scored, "gumbel_key", round(share * scored.count()))
    return scored.withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least))
