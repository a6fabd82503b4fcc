"""TIFF pages as rows: image directories, strips and tiles, PackBits, LZW and deflate, predictors.

``decode_pages`` walks the chain of image directories of each file (either byte order), decodes the
strips or tiles of each, undoes horizontal differencing, and emits one row a page with its samples.
``encode_page`` writes a one-page baseline file. Files are cut up with numpy inside Arrow batches;
a row's memory is its own file's.

Broken files cannot exhaust memory: a page's size is checked against the bytes of its strips, which can
expand ``EXPANSION`` times at most, and against ``most_bytes``, before anything is allocated, and codecs
stop at the bytes that a block needs. A file's pages are emitted as they are decoded.

Edge cases: null or broken files give a row with page null and the reason in ``error``; a file
without a directory gives none but that; a chain that returns to a directory ends there; a strip or
tile that is too short is filled with zeros; repeated rows give repeated pages.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: tags, field types and their sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPES = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Bytes that a byte of a strip can stand for, generously (deflate about 1,032).
EXPANSION = 4096
#: Bytes of pages that are emitted together.
BATCH_BYTES = 32_000_000

PAGES = "page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"


# ---------------------------------------------------------------- codecs


def packbits_decode(data: bytes, need: int = 1 << 62) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < need:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three equal bytes or more as repeats, the rest as literals."""
    out = bytearray()
    a = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]]) if len(a) else np.zeros(1, int)
    literal = bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if e - s < 3:
            literal.extend(data[s:e])
            continue
        flush()
        while e > s:
            n = min(128, e - s)
            out.extend((257 - n, data[s]) if n > 1 else (0, data[s]))
            s += n
    flush()
    return bytes(out)


def lzw_decode(data: bytes, need: int = 1 << 62) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a code's width grows one code early."""
    out: list[bytes] = []
    size = 0
    table: list[bytes] = []
    width, held, have, last = 9, 0, 0, b""
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, held = held >> have, held & (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code before its entry")
        if last and len(table) < 4096:
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        last, size = word, size + len(word)
        if size >= need:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    fresh = {bytes([i]): i for i in range(256)}
    table, width, word = dict(fresh), 9, b""
    size = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        codes.append((table[word], width))
        table[longer] = size
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
        if size >= 4094:
            codes.append((256, width))
            table, width, size = dict(fresh), 9, 258
        word = data[i : i + 1]
    if word:
        codes.append((table[word], width))
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
    codes.append((257, width))
    out, held, have = bytearray(), 0, 0
    for code, n in codes:
        held, have = held << n | code, have + n
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
            held &= (1 << have) - 1
    if have:
        out.append(held << 8 - have & 255)
    return bytes(out)


def _expand(data: bytes, scheme: int, need: int) -> bytes:
    """The first ``need`` bytes of a strip or tile."""
    if scheme == NONE:
        return data[:need]
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, need) if data else b""
    if scheme == LZW:
        return lzw_decode(data, need)[:need]
    if scheme == PACKBITS:
        return packbits_decode(data, need)[:need]
    raise ValueError(f"compression {scheme} is not supported")


def _compress(data: bytes, scheme: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda d: zlib.compress(d, 6), LZW: lzw_encode, PACKBITS: packbits_encode}[scheme](data)


# ---------------------------------------------------------------- files


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The image directories of a file: each tag with its values."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            letter = TYPES.get(kind)
            if letter is None:
                continue
            place = at + 10 + 12 * i
            if count * struct.calcsize(order + letter) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
        yield tags | {0: (order,)}
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def page_samples(data: bytes, tags: dict[int, tuple], most_bytes: int = 1 << 28) -> np.ndarray:
    """The samples of a page: rows x columns x samples of a pixel, of 8 or 16 bits."""
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    if not width or not height or bits not in (8, 16) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError("only pages of 8 or 16 bits a sample are supported")
    scheme, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not supported")
    kind = np.dtype(f"{tags[0][0]}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    if not across or not down or not samples:
        raise ValueError("a strip, tile or pixel without size")
    planes, deep = (samples, 1) if planar else (1, samples)
    total = width * height * samples * kind.itemsize
    if total > most_bytes or across * down * deep * kind.itemsize > most_bytes:
        raise ValueError(f"a page or tile of over {most_bytes} bytes")
    if total > EXPANSION * (min(len(data), sum(counts)) + 1):
        raise ValueError("a page larger than its strips can fill")
    if max(width, height) > 1 << 24:
        raise ValueError("a page too wide or too high")
    page = np.zeros((height, width, samples), kind.newbyteorder("="))
    spots = ((p, y, x) for p in range(planes) for y in range(0, height, down) for x in range(0, width, across))
    for (plane, y, x), offset, count in zip(spots, offsets, counts):
        tall = down if tiled else min(down, height - y)
        need = tall * across * deep * kind.itemsize
        raw = _expand(data[offset : offset + count], scheme, need)
        block = np.frombuffer(raw[:need].ljust(need, b"\0"), kind).astype(kind.newbyteorder("=")).reshape(tall, across, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        inside = block[: height - y, : width - x]
        page[y : y + tall, x : x + across, plane : plane + deep] = inside
    return page


def encode_page(samples: np.ndarray, scheme: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 256, tile: int = 0, order: str = "<") -> bytes:
    """One page of unsigned 8- or 16-bit samples (rows x columns, or x samples) as a TIFF file, in
    strips, or in square tiles of a multiple of 16."""
    page = samples[:, :, None] if samples.ndim == 2 else samples
    height, width, deep = page.shape
    kind = np.dtype(f"{order}u{page.dtype.itemsize}")
    across, down = (tile, tile) if tile else (width, min(rows_per_strip, height))
    parts = []
    for y in range(0, height, down):
        for x in range(0, width, across):
            block = page[y : y + down, x : x + across]
            if tile:
                block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            parts.append(_compress(block.astype(kind).tobytes(), scheme))
    tags: list[tuple[int, str, list[int]]] = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8 * kind.itemsize] * deep), (COMPRESSION, "H", [scheme]), (PHOTOMETRIC, "H", [1 if deep == 1 else 2]),
        (SAMPLES, "H", [deep]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor]),
    ]
    body = b"".join(parts)
    where = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]) + 8
    sizes = [len(p) for p in parts]
    if tile:
        tags += [(TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile]), (TILE_OFFSETS, "I", where.tolist()), (TILE_COUNTS, "I", sizes)]
    else:
        tags += [(ROWS_PER_STRIP, "I", [down]), (STRIP_OFFSETS, "I", where.tolist()), (STRIP_COUNTS, "I", sizes)]
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body)
    spare = at + 2 + 12 * len(tags) + 4
    entries, extra = b"", b""
    for tag, letter, values in sorted(tags):
        packed = struct.pack(f"{order}{len(values)}{letter}", *values)
        if len(packed) > 4:
            packed, extra = struct.pack(order + "I", spare + len(extra)), extra + packed + b"\0" * (len(packed) % 2)
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[letter], len(values)) + packed.ljust(4, b"\0")
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at)
    return head + body + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra


# ---------------------------------------------------------------- tables


def file_pages(data: bytes | None, most_bytes: int = 1 << 28) -> Iterator[dict]:
    """The pages of one file, or the reason why there are none."""
    try:
        if data is None:
            raise ValueError("no file")
        for number, tags in enumerate(directories(data)):
            page = page_samples(data, tags, most_bytes)
            yield {"page": number, "width": page.shape[1], "height": page.shape[0], "samples": page.shape[2], "bits": 8 * page.dtype.itemsize, "compression": tags.get(COMPRESSION, (NONE,))[0], "pixels": page.tobytes(), "error": None}
    except (ValueError, KeyError, TypeError, IndexError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:  # whatever a broken file leads to
        yield dict.fromkeys(("page", "width", "height", "samples", "bits", "compression", "pixels")) | {"error": str(e) or type(e).__name__}


def decode_pages(files: DataFrame, media: str = "media", most_bytes: int = 1 << 28) -> DataFrame:
    """One row a page of each TIFF file in the binary column ``media``, with all columns of ``files``; those
    with the name of a page's column, and one named ``file`` then, are fields of a struct ``file``. A page or
    tile of over ``most_bytes`` bytes is an error."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    own = T._parse_datatype_string(PAGES)
    clash = [c for c in files.columns if c in own.names]
    if clash:
        clash = [c for c in files.columns if c in clash or c == "file"]
        kept = [F.col(f"`{c}`") for c in files.columns if c not in clash]
        inner = [F.col(f"`{media}`").alias("of_media")] if media in clash else []
        pages = decode_pages(files.select(*kept, F.struct(*[F.col(f"`{c}`") for c in clash]).alias("file"), *inner), "of_media" if inner else media, most_bytes)
        return pages.drop("of_media") if inner else pages
    schema = T.StructType([*files.schema.fields, *own.fields])
    names = files.columns
    kinds = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "samples": pa.int32(), "bits": pa.int32(), "compression": pa.int32(), "pixels": pa.binary(), "error": pa.string()}

    def together(batch: pa.RecordBatch, owner: list[int], pages: list[dict]) -> pa.RecordBatch:
        kept = batch.take(pa.array(owner, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, *[pa.array([p[k] for p in pages], t) for k, t in kinds.items()]], names=[*names, *kinds])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(media))
            owner, pages, held = [], [], 0
            for i in range(batch.num_rows):
                for page in file_pages(column[i].as_py(), most_bytes):
                    owner.append(i)
                    pages.append(page)
                    held += len(page["pixels"] or b"")
                    if held >= BATCH_BYTES or len(pages) == 200:
                        yield together(batch, owner, pages)
                        owner, pages, held = [], [], 0
            if pages:
                yield together(batch, owner, pages)

    return files.mapInArrow(decode, schema)


def payload_of(text: str | None) -> bytes:
    """A text's UTF-8 bytes, filled with zeros to a positive multiple of 64."""
    data = (text or "").encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def form_of(payload: bytes) -> tuple[int, int]:
    """The scheme and tile size for a payload, chosen by its checksum alone: LZW for one in sixteen, as its
    loop is plain Python, PackBits for four, and deflate, in strips or in tiles. Equal payloads have equal forms."""
    nth = zlib.crc32(payload) % 16
    return (LZW, 0) if nth == 0 else (PACKBITS, 0) if nth < 5 else (DEFLATE, 0) if nth < 11 else (DEFLATE, 64)


def texts_as_files(docs: DataFrame, scheme: int | None = None, predictor: int = 2) -> DataFrame:
    """(doc_id, n_bytes, media): each text of ``docs(doc_id, text)`` as a page of 64 samples a row, in the
    given scheme or in the form that its payload chooses."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for low in range(0, batch.num_rows, 200):
                sizes, files = [], []
                for t in texts.slice(low, 200).to_pylist():
                    payload = payload_of(t)
                    form, tile = form_of(payload) if scheme is None else (scheme, 0)
                    files.append(encode_page(np.frombuffer(payload, np.uint8).reshape(-1, 64), form, predictor, tile=tile))
                    sizes.append(len((t or "").encode()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, 200), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def with_features(pages: DataFrame) -> DataFrame:
    """Pages with ``feature``: mean, deviation and a 16-bin histogram of their samples, as text."""
    from pyspark.sql import types as T

    names = pages.columns
    schema = T.StructType([*pages.schema.fields, T.StructField("feature", T.StringType())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pixels, bits in zip(batch.column(names.index("pixels")), batch.column(names.index("bits")).to_pylist()):
                if not pixels.is_valid:
                    out.append(None)
                    continue
                a = np.frombuffer(pixels.as_buffer(), f"<u{bits // 8}")
                bins = np.bincount(a >> (bits - 4), minlength=16)
                out.append(f"mean={a.mean():.4f};std={a.std():.4f};hist=" + ",".join(map(str, bins.tolist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "feature"])

    return pages.mapInArrow(describe, schema)
