"""Token-id output: flat files of unsigned integers with 64-bit document offsets.

A shard is three flat little-endian files that readers map into memory:

``NNNNNN.ids``      ids of its documents, one after another (16 bits if the vocabulary fits, else 32)
``NNNNNN.offsets``  64-bit: where each document starts in the shard, and the shard's total at last
``NNNNNN.docs``     64-bit: doc_id of each document

Shards are ranges of ascending doc_id, so shard and position give the corpus order. Each task writes
its own shard on the shared folder under a name of its attempt and renames it when it is whole; a
repeated task replaces the same bytes. The manifest has one row a shard; the first id of a shard in
the corpus is the prefix sum of the shards before it.

Edge cases: null text counts as empty and holds only the end id; null doc_ids come first and are
marked by the smallest 64-bit integer; rows with equal doc_id are each kept, in order of a hash of their text,
and may lie in several shards; an empty table gives an empty manifest; further columns are ignored.
A very long text costs about 60 times its bytes in its task, the tokenizer's library included.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docvigil.llm.common import materialize, new_folder, text_slices
from docvigil.llm.tokenizing import encoder, vocabulary_size

#: Marks a null doc_id in the files.
NO_ID = -(1 << 63)

MANIFEST = "shard int, path string, n_docs long, n_tokens long, width int"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"

#: Ids that a reader hands on together, unless one document has more.
BATCH_IDS = 1 << 20


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Tokenize ``docs(doc_id, text)`` into shards below ``folder`` and return the manifest with
    each shard's ``base``: the ids of all shards before it."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4
    # rows of one doc_id are spread by their text, equal rows by their place in the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("of_text"), F.monotonically_increasing_id().alias("nth"))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(shards, "doc_id", "of_text", "nth").sortWithinPartitions("doc_id", "of_text", "nth").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = _filesystem(folder)
        name = f"{root}/{shard:06d}"
        kind = f"<u{width}"
        files = None
        total, n_docs = 0, 0
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                if files is None:
                    store.create_dir(root, recursive=True)
                    files = {x: store.open_output_stream(f"{name}.{x}-{mark}") for x in ("ids", "offsets", "docs")}
                    files["offsets"].write(np.zeros(1, "<i8").tobytes())
                out, first = encoder(tokenizer).encode_ended(data, offsets, end_id)
                out = out.astype(kind)
                files["ids"].write(out.tobytes())
                files["offsets"].write((total + first[1:]).astype("<i8").tobytes())
                ids = batch.column("doc_id").slice(low, high - low).fill_null(NO_ID)
                files["docs"].write(ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                total, n_docs = total + len(out), n_docs + high - low
        if files is not None:
            for x, f in files.items():
                f.close()
                if store.get_file_info(f"{name}.{x}").is_file:  # a lost attempt's: some stores do not rename onto a file
                    store.delete_file(f"{name}.{x}")
                store.move(f"{name}.{x}-{mark}", f"{name}.{x}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{shard:06d}"], "n_docs": [n_docs], "n_tokens": [total], "width": pa.array([width], pa.int32())})

    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class _Flat:
    """A flat file: mapped into memory where the folder is mounted, else read by ranges."""

    def __init__(self, path: str, kind: str):
        store, name = _filesystem(path)
        self.kind = np.dtype(kind)
        self.mapped = self.file = None
        if store.type_name == "local":
            self.mapped = np.memmap(name, kind, "r") if os.path.getsize(name) else np.zeros(0, kind)
        else:
            self.file = store.open_input_file(name)
        self.size = len(self.mapped) if self.file is None else self.file.size() // self.kind.itemsize

    def part(self, low: int, high: int) -> np.ndarray:
        if self.file is None:
            return self.mapped[low:high]
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at(width * (high - low), width * low), self.kind)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the shards in ``manifest``: doc_id, its first id's place in the corpus,
    its number of ids and the ids as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _Flat(row["path"] + ".ids", f"<u{row['width']}")
                starts = _Flat(row["path"] + ".offsets", "<i8")
                docs = _Flat(row["path"] + ".docs", "<i8")
                low = 0
                while low < docs.size:
                    at = starts.part(low, min(low + 500, docs.size) + 1)
                    n = max(1, int(np.searchsorted(at, at[0] + BATCH_IDS, side="right")) - 1)  # whole documents
                    at, high = at[: n + 1], low + n
                    keys, found = docs.part(low, high), ids.part(int(at[0]), int(at[-1])).astype("<u4")
                    if len(found) >= 1 << 29:
                        raise ValueError("a document has over 2**29 ids, more than the 2 GB of a Spark value")
                    places = pa.py_buffer((4 * (at - at[0])).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys, mask=keys == NO_ID), pa.array(row["base"] + at[:-1]), pa.array(np.diff(at)),
                        pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, places, pa.py_buffer(found)]),
                    ], names=["doc_id", "start", "n_tokens", "ids"])
                    low = high

    dealt = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return dealt.mapInArrow(read, DOCUMENTS)
