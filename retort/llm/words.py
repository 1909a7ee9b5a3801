"""Words and word shingles of Arrow text columns, vectorised.

A word is a maximal run of characters other than space and U+0009 to U+000D. All
functions work on slices of a batch, so their memory follows the slice size and, at
the least, the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters of text that are worked on at once.
SLICE_BYTES = 12 << 20

_ODD = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(NamedTuple):
    """Words of some texts: ``codes[bounds[i]:bounds[i + 1]]`` are those of text i."""

    bounds: np.ndarray
    codes: np.ndarray
    distinct: pa.Array

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, equal on every machine."""
        if not len(self.distinct):
            return np.zeros(0, np.uint64)
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))
        return own[self.codes]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes; one long text stands alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // limit
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; ``lower`` maps A-Z to a-z first. A null text has none."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        flat = flat.filter(pa.array(full))
        bounds = np.r_[0, np.cumsum(full)][bounds]
    coded = flat.dictionary_encode()
    return Words(bounds, coded.indices.to_numpy().astype(np.int64), coded.dictionary)


def byte_table(kept: str) -> bytes:
    """A table for :func:`translated`: A-Z become a-z, bytes from 0x80 on and the characters of ``kept`` stay, all else is a space."""
    own = {ord(c): ord(c) for c in kept} | {c: c + 32 for c in range(0x41, 0x5B)}
    return bytes(b if b >= 0x80 else own.get(b, 0x20) for b in range(256))


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Texts with every byte mapped by a table of 256 that leaves bytes from 0x80 on as they are; a null text is empty."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    mapped = memoryview(data)[ends[0] : ends[-1]].tobytes().translate(table) if data is not None else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32).tobytes()), pa.py_buffer(mapped))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n values that begin at each place; the last n - 1 places have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : k + len(out)] * _ODD[k]
    return mix(out)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text, as 64-bit hashes.

    A text with fewer than n words has its whole sequence as one shingle; a text without
    words has none.
    """
    hashes = words.hashes()
    windows = window_hashes(hashes, n)
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(windows[a : b - n + 1]))
        elif b > a:
            whole = (hashes[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + _ODD[32 + int(b - a) % 32]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
