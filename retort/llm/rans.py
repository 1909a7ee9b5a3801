"""Static range asymmetric numeral system over token ids, interleaved over many lanes.

A block holds the ids of whole documents. Its ids fill rows of ``lanes`` places; each
lane is a coder of its own and all share one stream of 32-bit words, so that a row is
coded with a few numpy operations. Every ``stride`` rows the coder notes the lanes'
states and the place in the stream: a checkpoint, from which the ids up to the next one
decode on their own. What a checkpoint needs lies together as one segment with its own
checksum, so that tasks can decode segments of one block apart. The model is one
frequency table for all blocks.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

#: Frequencies sum up to 2 ** SCALE.
SCALE = 20
#: Format marker and version of a block.
MAGIC = b"RANS\x02\x00\x00\x00"

_U = np.uint64
_LOW, _WORD, _MASK = _U(1) << _U(32), _U(32), _U((1 << SCALE) - 1)
_HEAD = struct.Struct("<8sIIII")


class Model(NamedTuple):
    """A shared frequency table: ``freq`` and ``start`` by symbol, ``symbol`` by slot."""

    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray

    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def build_model(counts: np.ndarray) -> Model:
    """Scale counts by symbol so that they sum up to 2 ** SCALE and no counted symbol gets 0.

    The largest counts give or take what rounding leaves over. A lone symbol shares the
    range with an uncounted one, because no symbol may own all of it.
    """
    counts = np.asarray(counts, np.int64).copy()
    if len(counts) < 2:
        counts = np.r_[counts, np.zeros(2 - len(counts), np.int64)]
    if np.count_nonzero(counts) < 2:
        counts[np.flatnonzero(counts == 0)[: 2 - np.count_nonzero(counts)]] = 1
    if np.count_nonzero(counts) > 1 << (SCALE - 1):
        raise ValueError("too many symbols for the scale")
    total = 1 << SCALE
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * total).astype(np.int64)), 0)
    order = np.argsort(-freq, kind="stable")
    left, k = total - int(freq.sum()), 0
    if left > 0:
        freq[order[0]] += left
    while left < 0:
        take = min(-left, max(0, int(freq[order[k]]) // 2))
        freq[order[k]] -= take
        left, k = left + take, k + 1
    if freq.max() == total:
        raise AssertionError("one symbol fills the range")
    start = np.r_[0, np.cumsum(freq)[:-1]]
    return Model(freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


def encode_block(ids: np.ndarray, model: Model, lanes: int = 512, stride: int = 128) -> bytes:
    """One block: its segments, each behind its length, made of header, states, stream and a checksum of all before it."""
    rows = -(-len(ids) // lanes)
    filler = int(model.freq.argmax())
    grid = np.full(rows * lanes, filler, np.int64)
    grid[: len(ids)] = ids
    freq, start = model.freq[grid].reshape(rows, lanes), model.start[grid].reshape(rows, lanes)
    if rows and not freq.all():
        raise ValueError("an id is not in the frequency table")
    state = np.full(lanes, _LOW, _U)
    words: list[np.ndarray] = []
    segments: list[bytes] = []
    crc, per = model.crc(), stride * lanes
    for r in range(rows - 1, -1, -1):
        f = freq[r]
        full = state >= f << _U(64 - SCALE)
        if full.any():
            words.append((state[full] & _U(0xFFFFFFFF)).astype("<u4"))
            state = np.where(full, state >> _WORD, state)
        whole, rest = np.divmod(state, f)
        state = (whole << _U(SCALE)) + rest + start[r]
        if r % stride == 0:
            n = min(len(ids) - r * lanes, per)
            body = _HEAD.pack(MAGIC, n, lanes, sum(map(len, words)), crc) + state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))
            segments.append(body + struct.pack("<I", zlib.crc32(body)))
            words = []
    return b"".join(struct.pack("<I", len(x)) + x for x in reversed(segments))


def segments_of(block: bytes) -> list[bytes]:
    """The segments of a block, in order."""
    out, at = [], 0
    while at < len(block):
        n = int.from_bytes(block[at : at + 4], "little")
        out.append(block[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def decode_segment(segment: bytes, model: Model) -> np.ndarray:
    """The ids of one segment; ValueError where the checksum, the marker or the table's checksum differ."""
    if len(segment) < _HEAD.size + 4 or zlib.crc32(segment[:-4]) != struct.unpack("<I", segment[-4:])[0]:
        raise ValueError("a segment's checksum differs")
    magic, n, lanes, words_n, crc = _HEAD.unpack_from(segment)
    if magic != MAGIC or crc != model.crc():
        raise ValueError("a segment of another format or frequency table")
    state = np.frombuffer(segment, "<u8", lanes, _HEAD.size).astype(_U)
    stream = np.frombuffer(segment, "<u4", words_n, _HEAD.size + 8 * lanes).astype(_U)
    part, place = np.empty((-(-n // lanes), lanes), np.uint32), 0
    for r in range(len(part)):
        slot = state & _MASK
        part[r] = symbol = model.symbol[slot]
        state = model.freq[symbol] * (state >> _U(SCALE)) + slot - model.start[symbol]
        short = np.flatnonzero(state < _LOW)
        if len(short):
            state[short] = state[short] << _WORD | stream[place : place + len(short)]
            place += len(short)
    return part.ravel()[:n]


def decode_block(block: bytes, model: Model, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or those from checkpoint ``first`` to before checkpoint ``last``."""
    return np.concatenate([np.zeros(0, np.uint32), *(decode_segment(x, model) for x in segments_of(block)[first:last])])


def crc_of_joined(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of byte strings joined, from the (CRC-32, length) of each.

    Bytes behind a string multiply its remainder by x ** (8 * their number) modulo the polynomial.
    """

    def product(a: int, b: int) -> int:  # polynomials with the highest power in the lowest bit
        out = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    whole = 0
    for crc, n in parts:
        power = 1 << 23  # x ** 8
        while n:
            if n & 1:
                whole = product(power, whole)
            power, n = product(power, power), n >> 1
        whole ^= crc
    return whole
