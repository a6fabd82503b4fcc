"""What the training-data operators share: scratch tables on the shared folder, word
segmentation of Arrow batches in numpy, and exact selection by distributed histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvigil.operators.fixpoint import new_folder

#: The word pattern of the contracts: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles; bounds the working memory of a task.
SLICE_BYTES = 1_000_000  # below Powers.KEPT

_M64 = (1 << 64) - 1


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet on the shared folder and read it again: cuts the lineage, survives
    lost executors, and fixes values that a recomputation could number anew."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of the contracts' pattern; null counts as empty."""
    marked = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(marked, " "), lambda w: w != "")).cast("long")


def numbered(df: DataFrame, *keys: str, name: str = "name", deal: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a number from 0 for each row in the order of ``keys``, written so that it stays.

    Rows are dealt out by ranges of the keys, sorted and counted inside each range, and a range's first number
    is the sum of the counts before it, so numbers do not depend on the number of ranges. Keys must
    tell all rows apart. Bounds of ranges come from samples on the driver: where a key is long, ``deal`` names
    the first keys by which ranges are cut."""
    at = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    rows = df.repartitionByRange(*(deal or keys)).sortWithinPartitions(*keys).withColumn("at", at)
    rows = materialize(rows.withColumn("range", F.shiftright("at", 33)).withColumn("nth", F.col("at").bitwiseAND((1 << 33) - 1)).drop("at"), "ranges")
    counts = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(counts, "range").withColumn(name, F.col("nth") + F.col("before")).drop("range", "nth", "before")


# ---------------------------------------------------------------- numpy text


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    return _mix(x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _M64))


_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = mix(np.arange(256, dtype=np.uint64), 11)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64; up to ``KEPT`` of them are kept."""

    KEPT = 1 << 20

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        size = n if n > self.KEPT else 1 << (n - 1).bit_length()

        def grow(b: int) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        up, down = grow(self.base), grow(self.inverse)
        if size <= self.KEPT:
            self.up, self.down = up, down
        return up[:n], down[:n]


_POWERS = Powers(_BASE)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes that end a word of the contracts.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))


class Words:
    """The words of several texts in one byte buffer.

    ``start``/``end`` are byte positions, ``doc`` the text of each word, ``first`` the index of
    each text's first word (with the total as its last entry).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, stop: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~stop[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        begin, finish = offsets[:-1], offsets[1:]
        before[begin[begin < n]] = False
        after[finish[finish > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return words_hash(self.data, self.start, self.end)


def words_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of each run ``data[start:end]``, scrambled with its
    length. Runs are ascending; they are hashed in blocks of ``SLICE_BYTES``, so that working memory
    depends on the longest run only."""
    out = np.zeros(len(start), np.uint64)
    a = 0
    while a < len(start):
        low = int(start[a])
        b = max(a + 1, int(np.searchsorted(end, low + SLICE_BYTES, side="right")))
        high = int(end[b - 1])
        up, down = _POWERS.get(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data[low:high]] * up[: high - low], out=total[1:])
        raw = (total[end[a:b] - low] - total[start[a:b] - low]) * down[start[a:b] - low]
        out[a:b] = mix(raw ^ (end[a:b] - start[a:b]).astype(np.uint64), 3)
        a = b
    return out


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs one after another: start[0], start[0] + 1, ... of each run."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, UTF-8 bytes, offsets from 0) of runs of whole texts of about ``limit``
    bytes; null counts as empty, a text longer than the limit is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        last = min(last, n)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def segment_max(values: np.ndarray, first: np.ndarray, empty: float) -> np.ndarray:
    """Maximum over each run ``first[i]:first[i + 1]`` of rows; ``empty`` where a run has none."""
    out = np.full((len(first) - 1, *values.shape[1:]), empty, values.dtype)
    filled = first[1:] > first[:-1]
    if filled.any():
        out[filled] = np.maximum.reduceat(values, first[:-1][filled], axis=0)
    return out


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


# ---------------------------------------------------------------- bounded samples and selection


def hash_order(*cols: Column) -> Column:
    """A repeatable pseudo-random order of rows."""
    return F.xxhash64(*cols, F.lit("order"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> tuple[float | None, int]:
    """The k-th largest value of a double column and how many rows exceed it, exactly.

    Each round counts one histogram in Spark (``bins`` rows to the driver whatever the size of the
    input) and narrows the range to the bin with the k-th value, until that bin has one value.
    """
    values = df.select(F.col(key).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or k <= 0:
        return None, 0
    if k >= n:
        return low, n - 1
    above = 0
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        inside = values.filter((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        spot = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(width)))
        rows = inside.groupBy(spot.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return high, above


LONG = T.LongType()
