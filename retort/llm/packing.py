"""Packing of documents into equal token windows by Karmarkar-Karp multiway differencing.

Each task encodes its documents and gathers about ``BATCH_WINDOWS`` windows' worth of
ids. What fills whole windows by itself is cut off first. The rests are the items of a
multiway differencing: every item starts as a partition of its own, and the two
partitions with the largest imbalance are merged, the fullest window of one with the
emptiest of the other, until one partition is left whose windows are nearly equal. The
window count starts at what capacity asks for and rises whenever a window exceeds it,
until all rests fit uncut. With ``cut=True`` the windows that the count rose by are then
taken apart again, the emptiest ones, and their items fill the gaps of the others, whole
where they fit and cut where they don't.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.tokens import default_path, encoder, with_end
from retort.llm.words import slices

#: Ids that are packed together, in windows.
BATCH_WINDOWS = 256
#: Items from which on a batch is packed as soon as it fills a window, so that short texts don't pile up.
BATCH_ITEMS = 1 << 16
#: Ids that the windows of a batch leave free on average, at least, so that not every small gap has to be filled.
SLACK = 4
#: A batch leaves at most so many of its last items to the next one, to come close to that.
LAST_ITEMS = 64

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by Karmarkar-Karp differencing over ``windows`` windows.

    Ties go to the item that comes first. A partition is a vector of loads less its
    smallest one; merging adds one vector to the other reversed. Only imbalances are
    kept in the heap, and the members of a window are linked lists. Empty windows come
    first in a vector and are not stored, and an item alone is not stored at all, so all
    partitions together hold no more places than there are items.
    """
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64)
    after = np.full(n, -1, np.int64)
    merged: dict[int, np.ndarray] = {}  # rows: loads, first and last items
    heap = [(-int(s), k) for k, s in enumerate(sizes)]
    heapq.heapify(heap)

    def taken(k: int) -> np.ndarray:
        found = merged.pop(k, None)
        return np.array([[sizes[k]], [k], [k]], np.int64) if found is None else found

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        one, other = taken(a), taken(b)[:, ::-1]
        used, end = one.shape[1] + other.shape[1], other.shape[1]
        if used <= windows:
            both = np.concatenate([other, one], axis=1)
        else:
            front = windows - one.shape[1]  # windows from here to ``end`` get items of both
            met, own = one[:, : end - front], other[:, front:]
            both = np.empty((3, windows), np.int64)
            both[:, :front], both[:, end:] = other[:, :front], one[:, end - front :]
            both[0, front:end], both[1, front:end], both[2, front:end] = met[0] + own[0], met[1], own[2]
            after[met[2]] = own[1]
        both = both[:, np.argsort(both[0], kind="stable")]
        if used >= windows:
            both[0] -= both[0, 0]
        merged[a] = both
        heapq.heappush(heap, (-int(both[0, -1]), a))
    out = np.zeros(n, np.int64)
    heads = taken(heap[0][1])[1]
    for w, k in enumerate(heads, windows - len(heads)):
        while k >= 0:
            out[k] = w
            k = after[k]
    return out


def fill(sizes: np.ndarray, capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, begin, length); no item is longer than ``capacity``, each of its ids is in one window.

    The count rises by as many windows as the overhang fills, at least by one.
    """
    if not len(sizes):
        return []
    least = count = -(-int(sizes.sum()) // capacity)
    while True:
        window = difference(sizes, count)
        load = np.bincount(window, sizes, count).astype(np.int64)
        over = int(np.maximum(0, load - capacity).sum())
        if not over:
            break
        count += -(-over // capacity)
    full = np.argsort(-load, kind="stable")
    kept = full[: least if cut else np.count_nonzero(load)]
    place = np.full(count, -1)
    place[kept] = np.arange(len(kept))
    members: list[list[tuple[int, int, int]]] = [[] for _ in kept]
    for k in np.flatnonzero(place[window] >= 0):
        members[place[window[k]]].append((int(k), 0, int(sizes[k])))
    loose = np.flatnonzero(place[window] < 0)
    gaps = sorted((capacity - int(load[w]), int(place[w])) for w in kept if load[w] < capacity)
    for k in loose[np.argsort(-sizes[loose], kind="stable")]:
        begin, left = 0, int(sizes[k])
        while left:
            free, w = gaps.pop(min(bisect_left(gaps, (left, -1)), len(gaps) - 1))
            part = min(free, left)
            members[w].append((int(k), begin, part))
            begin, left = begin + part, left - part
            if part < free:
                insort(gaps, (free - part, w))
    return members


def left_over(sizes: np.ndarray, capacity: int) -> int:
    """How many of the last items are best left to the next batch: what the others' windows leave free comes closest to SLACK each."""
    totals = np.cumsum(sizes)[::-1][: min(LAST_ITEMS, len(sizes))]
    if not len(totals):
        return 0
    windows = -(-totals // capacity)
    free = windows * capacity - totals
    return int(np.argmin(np.where(free < SLACK * windows, free + capacity, free) / windows))


def pack(
    docs: DataFrame, capacity: int = 4096, end_id: int = 2, tokenizer_path: str | None = None, cut: bool = True, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Windows of at most ``capacity`` ids from all texts, each followed by ``end_id``.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset (gapless within the sequence), and with ``with_ids`` the piece's ids.
    Windows are formed within the input's partitions, so nothing is shuffled; each task
    leaves at most one window that is not nearly full. With ``cut=False`` documents longer
    than ``capacity`` are still cut into whole windows and a rest.

    A null or empty text is its end id alone. Rows with one doc_id are separate
    documents; a null doc_id stays null. An empty table gives an empty result; extra columns are not read.
    """
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        names: list[int | None] = []
        texts: list[np.ndarray] = []
        begins: list[int] = []
        totals: list[int] = []
        held = 0

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            """Cut whole windows off long items, then fill windows; a few last items may wait for more."""
            nonlocal sequence, names, texts, begins, totals, held
            rows: list[tuple] = []
            whole = [(k, begin, capacity) for k, t in enumerate(texts) for begin in range(0, len(t) // capacity * capacity, capacity)]
            windows = [[w] for w in whole]
            base = np.array([len(t) // capacity * capacity for t in texts], np.int64)
            sizes = np.array([len(t) for t in texts], np.int64) - base
            items = np.flatnonzero(sizes)
            late = 0 if last else left_over(sizes[items], capacity)
            rest = [(int(k), int(base[k])) for k in items[len(items) - late :]]
            items = items[: len(items) - late]
            for members in fill(sizes[items], capacity, cut):
                windows.append([(int(items[k]), int(base[items[k]]) + begin, n) for k, begin, n in members])
            for members in windows:
                offset = 0
                for k, begin, n in members:
                    raw = texts[k][begin : begin + n].astype("<u4").tobytes()
                    rows.append((names[k], begins[k] + begin, n, zlib.crc32(raw), totals[k], sequence, offset, raw if with_ids else None))
                    offset += n
                sequence += 1
            waiting = [(names[k], texts[k][begin:], begins[k] + begin, totals[k]) for k, begin in rest]
            names, texts, begins, totals = ([w[i] for w in waiting] for i in range(4))
            held = sum(len(t) for t in texts)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.binary()], strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])

        for batch in batches:
            for part in slices(batch, "text"):
                bounds, ids = with_end(*encoder(path).encode(part.column("text")), end_id)
                for name, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    names.append(name)
                    texts.append(ids[a:b])
                    begins.append(0)
                    totals.append(int(b - a))
                    held += int(b - a)
                    if held >= BATCH_WINDOWS * capacity or (len(names) >= BATCH_ITEMS and held >= capacity):
                        yield from packed(False)
        yield from packed(True)

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)
    return out if with_ids else out.drop("ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, each with end id 2, in sequences of at most 4096 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4096, 2, with_ids=False)
