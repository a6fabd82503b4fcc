"""Substring duplicates: Rabin-Karp hashes of word windows, counted in Spark, merged into intervals.

A word is removed if a window of ``window`` consecutive words that covers it also starts in a text
with a smaller doc_id. Windows are judged on the input.

Every window of every text gets rolling hashes (two Rabin-Karp polynomials over 64-bit word hashes,
together 96 bits). Shuffling them all would multiply the input, so windows first prove that they can
repeat: among the shorter runs of ``window // 2`` words inside a window, the one with the smallest
hash is its anchor. Equal windows have equal anchors, so a window whose anchor no other text has is
settled at once; about two anchors in ``window // 2`` words are shuffled. Windows of shared anchors
are then counted by their full hashes: the smallest doc_id of each that other texts repeat goes back
to the places where it occurs, places merge into maximal intervals, and the texts are cut.

Equal texts are represented by the one with the smallest doc_id: all windows of the others start
there too, so these lose every word if they have a window at all. Hot windows are pre-aggregated
before the shuffle; the join back has a written table on one side, so adaptive execution can split
it. What a text collects is bounded by its own length.

Edge cases: null text counts as empty; texts with fewer words than a window keep all; windows that
repeat only inside one text stay; of rows with equal doc_id none is smaller, so they do not remove
each other, and each of their texts is judged by itself; null doc_ids neither remove nor lose words; an empty table gives an empty result.
A very long text costs about 30 times its bytes in its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvigil.llm.common import SPACE, Powers, Words, materialize, mix, text_slices

#: Windows that are hashed at once.
BLOCK = 400_000

_FIRST, _SECOND = Powers(0x9E6C63D0876A9A47), Powers(0xB5297A4D3F84D5B5)


def _rolling(codes: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """Rabin-Karp hash of each run of ``n`` codes, modulo 2**64."""
    up, down = powers.get(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return (total[n:] - total[:-n]) * down[: len(codes) - n + 1] if len(codes) >= n else np.zeros(0, np.uint64)


def _sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each ``n`` neighbours: minima of prefixes and suffixes of blocks of n."""
    if len(values) < n:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-len(values) // n) * n, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, n)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(values) - n + 1
    return np.minimum(back[:m], ahead[n - 1 : n - 1 + m])


class Windows:
    """Anchors and hashes of the windows that start at words ``a`` to ``b`` of a slice of texts."""

    def __init__(self, words: Words, codes: np.ndarray, doc: np.ndarray, a: int, b: int, window: int):
        b = min(b, len(codes) - window + 1)
        codes, ahead = codes[a : b + window - 1], doc[a + window - 1 : b + window - 1]
        short = max(1, window // 2)
        runs = mix(_rolling(codes, short, _FIRST), 5)
        self.anchor = _sliding_min(runs, window - short + 1)
        self.high = mix(_rolling(codes, window, _FIRST), 6)
        self.low = mix(_rolling(mix(codes, 7), window, _SECOND), 8)
        self.doc = doc[a:b]
        self.valid = self.doc == ahead  # a window ends in the text in which it starts
        self.pos = np.arange(a, b) - words.first[self.doc]


def windows(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[Windows]:
    """The windows of the texts of a slice, in blocks, so that a long text does not need its hashes all
    at once."""
    words = Words(data, offsets, SPACE)
    codes, doc = words.hashes(), words.doc.astype(np.int32)
    for a in range(0, len(codes) - window + 1, BLOCK):
        yield Windows(words, codes, doc, a, a + BLOCK, window)


def _anchors(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "sub"))
            for low, _, data, offsets in text_slices(batch.column("text")):
                for w in windows(data, offsets, window):
                    doc, anchor = w.doc[w.valid], w.anchor[w.valid]
                    fresh = np.ones(len(doc), bool)  # neighbouring windows mostly share their anchor
                    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                    row = low + doc[fresh]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(subs[row], pa.int64()), pa.array(anchor[fresh].view(np.int64))], names=["id", "sub", "anchor"])

    return emit


def _candidates(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "sub"))
            shared = batch.column("shared")
            for low, high, data, offsets in text_slices(batch.column("text")):
                known = np.unique(shared.slice(low, high - low).flatten().to_numpy())
                for w in windows(data, offsets, window) if len(known) else ():
                    r = np.flatnonzero(w.valid)
                    anchor = w.anchor[r].view(np.int64)
                    spot = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
                    r = r[known[spot] == anchor]
                    row = low + w.doc[r]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(w.high[r].view(np.int64)), pa.array((w.low[r] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(ids[row], pa.int64()), pa.array(subs[row], pa.int64()), pa.array(w.pos[r].astype(np.int32)),
                    ], names=["h1", "h2", "id", "sub", "pos"])

    return emit


def _cut(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, places = batch.column("copy").to_pylist(), batch.column("places")
            for low, high, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets, SPACE)
                n_words, n_removed, digests, spans = [], [], [], []
                joined = data.tobytes()
                for i in range(high - low):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    gone = np.zeros(b - a + 1, np.int32)
                    if copies[low + i] and b - a >= window:
                        gone[0] = 1
                    elif places[low + i].is_valid:
                        at = np.asarray(places[low + i].values)
                        at = at[at + window <= b - a]
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    kept = np.cumsum(gone[:-1]) == 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], kept, [True]])))
                    n_words.append(b - a)
                    n_removed.append(int((~kept).sum()))
                    digest, left = hashlib.sha256(), a + np.flatnonzero(kept)
                    for c in range(0, len(left), 50_000):
                        part = left[c : c + 50_000]
                        digest.update(b" " * (c > 0) + b" ".join([joined[s:e] for s, e in zip(words.start[part].tolist(), words.end[part].tolist())]))
                    digests.append(digest.hexdigest())
                    spans.append([{"first": int(s), "last": int(e)} for s, e in zip(edges[::2], edges[1::2])])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, high - low), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return emit


def repeated_windows(docs: DataFrame, copies: DataFrame, window: int) -> DataFrame:
    """(id, sub, places): the first words of the windows of ``docs(id, sub, text)`` that start in an
    earlier text; ``copies(id, sub)`` are left out."""
    anchors = materialize(docs.select("id", "sub", "text").mapInArrow(_anchors(window), "id long, sub long, anchor long"), "anchors")
    own = anchors.join(copies, ["id", "sub"], "left_anti")
    common = materialize(own.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("anchor"), "shared")
    by_doc = materialize(own.join(common, "anchor").groupBy("id", "sub").agg(F.collect_set("anchor").alias("shared")), "by_doc")
    some = docs.join(by_doc, ["id", "sub"]).select("id", "sub", "text", "shared")
    found = materialize(some.mapInArrow(_candidates(window), "h1 long, h2 int, id long, sub long, pos int"), "windows")
    first = materialize(found.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").drop("hi"), "first")
    again = found.join(first, ["h1", "h2"]).filter("id > lo")
    return materialize(again.groupBy("id", "sub").agg(F.collect_set("pos").alias("places")), "places")


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: ``n_words``, ``n_removed``, ``kept_sha256`` of the kept
    words joined by single spaces, and ``removed``, the maximal intervals [first, last) of words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    #: rows with equal doc_id are told apart by a hash of their texts
    keyed = rows.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("sub"), "text")
    hashed = keyed.select("id", "sub", F.sha2("text", 256).alias("sha"))
    least = materialize(hashed.groupBy("sha").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "equal")
    copies = materialize(hashed.join(least, "sha").filter("id > lo").select("id", "sub").distinct(), "copies")
    places = repeated_windows(keyed.filter("id IS NOT NULL"), copies, window)
    marks = copies.select("id", "sub", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("places")).unionByName(places.select("id", "sub", F.lit(False).alias("copy"), "places"))
    marks = materialize(marks.groupBy("id", "sub").agg(F.max("copy").alias("copy"), F.first("places", ignorenulls=True).alias("places")), "marks")
    cut = keyed.join(marks, ["id", "sub"], "left").select(F.col("id").alias("doc_id"), "text", F.coalesce("copy", F.lit(False)).alias("copy"), "places")
    return cut.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:long,last:long>>")


def cut_text(text: str, removed: list) -> str:
    """The kept words of a text, joined by single spaces."""
    words = [w for w in text.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    gone = {i for r in removed for i in range(r["first"], r["last"])}
    return " ".join(w for i, w in enumerate(words) if i not in gone)
