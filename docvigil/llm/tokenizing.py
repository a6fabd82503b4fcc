"""Token ids of whole texts with a public tokenizer file, fast enough for Spark tasks.

The library spends most of its time merging the same words again. Both public vocabularies cut a text
into pieces of letters, digits or other signs, so a text's ids are those of its chunks, one after
another: a run of letters, digits or signs with the blank before it, or white space. A cut is made
only where both sides are ASCII or Latin-1 and the vocabularies' patterns cannot join them (not
between an apostrophe and a letter). Where the vocabulary drops white space, chunks go without it, and
where it lowers its input, letters of these blocks are lowered first.

Numpy cuts a slice of texts into chunks and names each by a 64-bit hash; the library encodes only
chunks that the Python worker has not seen, runs of letters without its pattern step, which would not
cut them. A known chunk's bytes are compared before its ids are taken, so a hash decides nothing. What
a worker remembers is bounded by ``CACHE_BYTES``: beyond that it forgets what it did not use again.

A text with white space other than blank, tab and line break, or with a special token's brackets, is
encoded as a whole; so is a slice in which two chunks share a hash.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from docvigil.llm.common import byte_class, spread, words_hash

#: Bytes of chunks and ids that a Python worker remembers.
CACHE_BYTES = 40_000_000

#: Kinds of bytes; those of other characters than blanks, ASCII and Latin-1 letters are OTHER.
_BLANK, _LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:128] = _SIGN
_KIND[[9, 10, 13, 32]] = _BLANK
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _QUOTE
#: Whether a chunk ends between two kinds.
_CUT = np.zeros((6, 6), bool)
_CUT[[_LETTER, _DIGIT], :] = _CUT[:, _BLANK] = True
_CUT[_SIGN, [_LETTER, _DIGIT]] = True
_CUT[_BLANK, :] = _CUT[:, _OTHER] = _CUT[np.arange(6), np.arange(6)] = False
_CUT = _CUT.ravel()
_LATIN_1 = 0xC3  # leads U+00C0 to U+00FF, letters but for two signs, capitals 32 before small ones
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: First bytes of other white space (alone, or of U+0085 U+00A0, U+1680, U+2000.., U+3000) and of "<|".
_SUSPECT = byte_class((0x0B, 0x0C), (0x1C, 0x1F), (0xC2, 0xC2), (0xE1, 0xE3), (60, 60))
_ODD_TWO = {0xC285, 0xC2A0, 0x3C7C}
_ODD_THREE = {0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080, *range(0xE28080, 0xE2808B)}
_ENCODERS: dict[str, Encoder] = {}


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts cannot be cut at blanks."""
    odd = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero(_SUSPECT[data])
    if len(at):
        more = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = data[at].astype(np.int64), more[at].astype(np.int64) << 8 | more[at + 1]
        found = (one < 0x20) | np.isin(two, list(_ODD_TWO)) | np.isin(two << 8 | more[at + 2], list(_ODD_THREE))
        odd[np.searchsorted(offsets, at[found], side="right") - 1] = True
    return odd


def _byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str()).get("normalizer") or {}
        steps = [x["type"] for x in steps.get("normalizers", [steps]) if x]
        self.lowers = "Lowercase" in steps
        self.blanks = "Replace" not in steps
        self.lean = Tokenizer(self.tokenizer.model)  # the same merges, without normalizer and pattern
        self.kind = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes and their chunks
        self.used = np.zeros(0, bool)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int32)
        self.ids, self.ids_at = np.zeros(0, self.kind), np.zeros(1, np.int32)

    def _trim(self) -> None:
        """Within the bound, keep the chunks that were met again."""
        if self.text.nbytes + self.ids.nbytes + 21 * len(self.rows) <= CACHE_BYTES:
            return
        keep = np.flatnonzero(self.used)
        if len(keep) > len(self.used) // 2:
            keep = keep[len(keep) // 2 :]
        place = np.full(len(self.used), -1, np.int32)
        place[keep] = np.arange(len(keep))
        for name in ("text", "ids"):
            at = getattr(self, f"{name}_at")
            size = np.diff(at)[keep]
            setattr(self, name, getattr(self, name)[spread(at[keep].astype(np.int64), size)])
            setattr(self, f"{name}_at", np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        rows = place[self.rows]
        self.hashes, self.rows = self.hashes[rows >= 0], rows[rows >= 0]
        self.used = np.zeros(len(keep), bool)

    def _library(self, texts: list[str], lean: bool = False) -> list[list[int]]:
        return [x.ids for x in (self.lean if lean else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, texts: list[bytes], lean: np.ndarray) -> list[list[int]]:
        out: list = [None] * len(texts)
        for flag in (False, True):
            which = np.flatnonzero(lean == flag).tolist()
            some = [texts[i] for i in which]
            if flag:
                named = b"\n".join(some).decode("latin-1").translate(_BYTE_LETTERS | {10: 10}).split("\n") if some else []
                found = self._library(named, True)
            else:
                found = self._library([x.decode() for x in some])
            for i, x in zip(which, found):
                out[i] = x
        return out

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the chunks of the texts start and end, and which are letters (after a blank)."""
        n = len(data)
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == _LATIN_1)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        edge = np.zeros(n + 1, bool)
        edge[1:n] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
        blank = kind == _BLANK
        if self.blanks:  # the last blank before a word goes with it, another white space does not
            within = blank[:-1] & ~blank[1:]
            within[offsets[(offsets > 0) & (offsets < n)] - 1] = False
            last = np.flatnonzero(within)
            inner = last[last > 0]
            edge[inner] = True
            edge[last[data[last] != 32] + 1] = True
        else:
            edge[1:n] |= blank[:-1] & ~blank[1:]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        if not self.blanks:
            start, end = start[~blank[start]], end[~blank[start]]
        rest = np.concatenate([[0], np.cumsum(kind != _LETTER, dtype=np.int32)])
        return start, end, rest[end] - rest[start] == ((data[start] == 32) & (end - start > 1))

    def _rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lean: np.ndarray) -> np.ndarray | None:
        """The remembered chunk of each chunk, after the library has seen the new ones; None if
        two chunks share a hash."""
        import pyarrow as pa

        code = pa.array(words_hash(data, start, end)).dictionary_encode()
        which, names = code.indices.to_numpy(), code.dictionary.to_numpy()
        spot = np.searchsorted(self.hashes, names)
        new = np.ones(len(names), bool)
        inside = spot < len(self.hashes)
        new[inside] = self.hashes[spot[inside]] != names[inside]
        row = np.zeros(len(names), np.int64)
        row[~new] = self.rows[spot[~new]]
        self.used[row[~new]] = True
        fresh = np.flatnonzero(new)
        if len(fresh):
            sample = np.zeros(len(names), np.int64)
            sample[which[::-1]] = np.arange(len(which))[::-1]  # the first chunk of each name
            some = sample[fresh]
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())]
            found = self._new(texts, lean[some])
            row[fresh] = np.arange(len(fresh)) + len(self.used)
            order = fresh[np.argsort(names[fresh], kind="stable")]
            self.hashes, self.rows = np.insert(self.hashes, spot[order], names[order]), np.insert(self.rows, spot[order], row[order].astype(np.int32))
            self.used = np.concatenate([self.used, np.zeros(len(fresh), bool)])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.text_at = np.concatenate([self.text_at, (self.text_at[-1] + np.cumsum(end[some] - start[some])).astype(np.int32)])
            self.text = np.concatenate([self.text, np.frombuffer(b"".join(texts), np.uint8)])
            self.ids_at = np.concatenate([self.ids_at, (self.ids_at[-1] + np.cumsum(sizes)).astype(np.int32)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum()))])
        found = row[which]
        sizes = end - start
        if not np.array_equal(sizes, np.diff(self.text_at)[found]):
            return None
        same = self.text[spread(self.text_at[found], sizes)] == (data if int(sizes.sum()) == len(data) else data[spread(start, sizes)])
        return found if same.all() else None

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8), one after
        another, and where each text's ids begin, with their number at last."""
        odd = odd_texts(data, offsets)
        start, end, lean = self.chunks(data, offsets)
        plain = data
        if self.lowers:
            plain = _LOWER[data]
            tail = np.flatnonzero(data[:-1] == _LATIN_1) + 1
            tail = tail[(data[tail] < 0x9F) & (data[tail] != 0x97)]
            plain[tail] += 32
        if odd.any():
            keep = ~odd[np.searchsorted(offsets, start, side="right") - 1]
            start, end, lean = start[keep], end[keep], lean[keep]
        rows = self._rows(plain, start, end, lean) if len(start) else np.zeros(0, np.int64)
        if rows is None:
            odd[:] = True
            rows, start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.diff(self.ids_at)[rows].astype(np.int64)
        ids = self.ids[spread(self.ids_at[rows], size)].astype(np.uint32)
        first = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, offsets)]
        if odd.any():
            whole = np.flatnonzero(odd).tolist()
            parts, below, more = [], 0, np.zeros(len(first), np.int64)
            for i, found in zip(whole, self._library([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in whole])):
                parts += [ids[below : first[i]], np.array(found, np.uint32)]
                below = first[i]
                more[i + 1] = len(found)
            ids = np.concatenate([*parts, ids[below:]])
            first = first + np.cumsum(more)
        self._trim()
        return ids, first

    def encode_ended(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` with ``end_id`` after each text's ids."""
        ids, first = self.encode(data, offsets)
        n = len(first) - 1
        out = np.full(len(ids) + n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))] = ids
        return out, first + np.arange(n + 1)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_size(path: str) -> int:
    return encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)
