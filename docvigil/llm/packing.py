"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many pieces of the context
length as fit, then the binary digits of the rest in falling order. A sequence is one piece, so none
crosses documents and none needs padding; training draws a batch from one bucket of equal lengths.

The pieces stay in the task that tokenized the document: no shuffle. ``sequence_id`` numbers the
pieces by input partition and place, as the input is read.

Edge cases: null text counts as empty and gives one piece with the end id; rows with equal doc_id
(copies of a mix) are each packed, told apart by ``sequence_id``; null doc_ids are kept; an empty
table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvigil.llm.common import text_slices
from docvigil.llm.tokenizing import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary"


def pieces(sizes: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of documents of ``sizes`` ids, in order: each one's document and its place there.
    Lengths are powers of two, falling, that add up to the size; none is above ``context``, itself a
    power of two."""
    whole, rest = sizes // context, sizes % context
    bits = np.arange(context.bit_length() - 2, -1, -1)
    digits = (rest[:, None] >> bits[None, :]) & 1
    per = whole + digits.sum(1)
    owner = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = np.minimum(nth, whole[owner]) * context
    doc, column = np.nonzero(digits)
    tail = nth >= whole[owner]
    above = digits * (1 << bits)[None, :]
    at[tail] += (np.cumsum(above, axis=1) - above)[doc, column]  # np.nonzero is in the pieces' order
    return owner, at


#: Pieces that are handed on together: at most so many times ``context`` ids.
BATCH_PIECES = 4096


def pack(docs: DataFrame, tokenizer: str, end_id: int, context: int = 2048) -> DataFrame:
    """Sequences of ``docs(doc_id, text)``: one row a piece with its ids (little-endian unsigned
    32-bit integers), its place in the document, its bucket (log2 of its length) and sequence."""
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id")
            for low, _, data, offsets in text_slices(batch.column("text")):
                ids, first = encoder(tokenizer).encode_ended(data, offsets, end_id)
                owner, at = pieces(np.diff(first), context)
                where = np.append(first[owner] + at, len(ids))
                length, tokens, ids = np.diff(where), np.diff(first)[owner], ids.astype("<u4", copy=False)
                for a in range(0, len(owner), BATCH_PIECES):
                    b = min(a + BATCH_PIECES, len(owner))
                    places = pa.py_buffer((4 * (where[a : b + 1] - where[a])).astype(np.int32))
                    cut_ids = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, places, pa.py_buffer(ids[where[a] : where[b]])])
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array(low + owner[a:b])), pa.array(at[a:b]), pa.array(length[a:b]), pa.array(tokens[a:b]), pa.array(np.log2(length[a:b]).astype(np.int32)), cut_ids,
                    ], names=["doc_id", "start", "length", "doc_tokens", "bucket", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, PIECES).select("doc_id", "start", "length", "doc_tokens", "bucket", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder of sequences for each length, from which equal-length batches are drawn."""
    packed.write.partitionBy("bucket").parquet(path)
