"""Benchmark decontamination: word n-gram and rare-word seeds, then Smith-Waterman alignment.

One pass over the documents, in which each task joins its own texts with the test items by
seeds and aligns them. Seeds are the rarest n-grams of an item, and its rarest words for
copies that are edited so often that few n-grams are left; how many of them, and how many
have to lie close together, follows from a counting bound (:func:`_chosen`), so that every
copy at the limit is met. How rare they are is counted in the texts at hand and only sets how
many passages are tried. Passages that reach as far from a seed as an alignment at the limit
can are dropped if their words cannot reach the limit in any order, and aligned word by word
otherwise. So the result is that of aligning every document with every item. Test items are
taken in blocks of bounded size, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.scratch import written
from retort.llm.words import Words, slices, split_words, window_hashes

#: Words of test items that one block may hold; about 30 bytes of each are broadcast.
BLOCK_GRAMS = 1 << 21
#: Seed hits, and places of alignment tables, that are worked on at once.
CHUNK = 1 << 20
#: Numbers of seeds that may be needed together, and of common n-grams that may be left out.
NEEDED, SKIPPED = (1, 2, 3, 4, 6, 8), (0, 1, 2, 4, 8)
#: Cost of a passage, as occurrences of seeds.
PASSAGE = 400
#: Alignment scores of a word that is equal, replaced, or missing on one side.
MATCH, MISMATCH, GAP = 2, -1, -1


def _words(texts: pa.Array) -> Words:
    """Words in lower case and without marks, so that punctuation and case don't count as edits."""
    return split_words(pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[^\pL\pN\s]+", "")))


def item_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words, n_words) of the test items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = _words(part.column("text"))
                names = words.distinct.to_pylist()
                text = [" ".join(names[c] for c in words.codes[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(text, pa.string()), pa.array(np.diff(words.bounds))], ["item_id", "words", "n_words"])

    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id long, words string, n_words long")


class Items(NamedTuple):
    """A block of test items: item i is ``codes[bounds[i]:bounds[i + 1]]``, numbers of words in ``vocabulary``."""

    ids: list[int | None]
    bounds: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array
    #: Sorted distinct n-grams, and the number of the one that begins at each word of an item, -1 at its last n - 1 words.
    grams: np.ndarray
    gram_at: np.ndarray
    #: Least score of a copy, and words of a text it may span.
    least: np.ndarray
    span: np.ndarray


def prepared(rows: list[tuple[int | None, str]], n: int, similarity: float, long_score: int) -> Items:
    """The items of (item_id, words) rows, each of at least ``n`` words."""
    texts = split_words(pa.array([w for _, w in rows], pa.string()))
    bounds, codes = texts.bounds, texts.codes
    size = np.diff(bounds)
    ends = np.repeat(bounds[1:], size)
    hashes = window_hashes(codes.astype(np.uint64), n)
    at = np.flatnonzero(np.arange(len(hashes)) + n <= ends[: len(hashes)])
    grams, number = np.unique(hashes[at], return_inverse=True)
    gram_at = np.full(len(codes), -1)
    gram_at[at] = number
    least = np.maximum(1, np.ceil(np.minimum(MATCH * size * similarity, long_score) - 1e-9)).astype(np.int64)
    return Items([i for i, _ in rows], bounds, codes, texts.distinct, grams, gram_at, least, size + np.maximum(0, MATCH * size - least))


class Seeds(NamedTuple):
    """Words or n-grams of the items that may be seeds, rarest first within each item."""

    #: Item and key of each, and where those of an item begin.
    owner: np.ndarray
    key: np.ndarray
    starts: np.ndarray
    #: ``sums[k]``: how often the first k occur in the texts.
    sums: np.ndarray

    def occurrences(self, many: np.ndarray) -> np.ndarray:
        """How often the ``many`` rarest of each item occur."""
        return (self.sums[self.starts[:-1] + many] - self.sums[self.starts[:-1]]).astype(float)

    def rarest(self, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, items) of the ``many`` rarest of each item."""
        own = np.arange(len(self.key)) - self.starts[self.owner] < many[self.owner]
        return self.key[own], self.owner[own]


def _ranked(items: Items, keys: np.ndarray, count: int, places: np.ndarray) -> Seeds:
    """The items' ``keys``, without those below 0, by how often they are among the texts' ``places``."""
    seen = np.bincount(places[places >= 0], minlength=count)
    at = np.flatnonzero(keys >= 0)
    owner = np.searchsorted(items.bounds, at, side="right") - 1
    order = np.lexsort((seen[keys[at]], owner))
    key = keys[at][order]
    return Seeds(owner, key, np.searchsorted(owner, np.arange(len(items.ids) + 1)), np.r_[0, np.cumsum(seen[key])])


def _chosen(items: Items, words: Seeds, grams: Seeds, n: int, places: int) -> tuple[np.ndarray, ...]:
    """(n-grams, n-grams needed, words, words needed) of each item: seeds that every copy holds, and fewest passages.

    Let a copy have k equal words in r stretches, so at most 2 k - r + 1 as its score and at
    least k - (n - 1) r equal n-grams. Then it has either ``needed`` of the n-grams that are
    left without the ``skipped`` commonest, or fewer than both together in all; in that case
    its score tells how many equal words it must have at least, and all but that many of the
    item's words, the commonest left out, hold one. With ``needed`` - 1 words more they hold
    ``needed``. Among some such choices the one is taken that has the fewest occurrences in
    the texts, and passages counted as if they fell anywhere.
    """
    size, runs = np.diff(items.bounds), np.diff(grams.starts)
    rate = items.span / max(1, places)
    least_cost, best = np.full(len(size), np.inf), np.zeros((4, len(size)), np.int64)
    for needed in NEEDED if n > 1 else (1,):
        for skipped in SKIPPED if n > 1 else (0,):
            if n > 1:
                equal = np.maximum(-(-items.least // MATCH), -(-((items.least - 1) * (n - 1) - (needed + skipped - 1)) // (2 * n - 3)))
            else:
                equal = size + 1
            left = np.maximum(0, runs - skipped)
            of_grams = grams.occurrences(left)
            cost_grams = of_grams + PASSAGE * of_grams * np.minimum(1, of_grams * rate) ** (needed - 1)
            for some in NEEDED:
                some = np.minimum(some, equal)
                many = np.where(equal > size, 0, size - equal + some)
                of_words = words.occurrences(many)
                cost = cost_grams + of_words + PASSAGE * of_words * np.minimum(1, of_words * rate) ** (some - 1)
                better = cost < least_cost
                least_cost = np.where(better, cost, least_cost)
                for row, value in zip(best, (left, needed, many, some), strict=True):
                    row[better] = np.broadcast_to(value, len(size))[better]
    return tuple(best)


def _met(keys: np.ndarray, items: np.ndarray, count: int, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, items): the texts' ``places`` joined to the items by key, about ``CHUNK`` at a time in order of places."""
    order = np.lexsort((items, keys))
    keys, items = keys[order], items[order]
    new = np.r_[True, (np.diff(keys) != 0) | (np.diff(items) != 0)][: len(keys)]
    keys, items = keys[new], items[new]
    starts = np.searchsorted(keys, np.arange(count + 1))
    many = np.where(places >= 0, np.diff(starts)[places], 0) if count else np.zeros(len(places), np.int64)
    at = np.flatnonzero(many)
    for own in np.split(at, np.flatnonzero(np.diff(np.cumsum(many[at]) // CHUNK)) + 1):
        if len(own):
            each = np.repeat(own, many[own])
            nth = np.arange(len(each)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
            yield each, items[starts[places[each]] + nth]


def _together(found: Iterator[tuple[np.ndarray, np.ndarray]], needed: np.ndarray, span: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those (places, items) that have ``needed`` places of one item within its span of one text.

    Places near the end of a part are looked at again with the next part.
    """
    place = item = np.zeros(0, np.int64)
    for new_place, new_item in found:
        place, item = np.r_[place, new_place], np.r_[item, new_item]
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        last = np.arange(len(place)) + needed[item] - 1
        end = np.minimum(last, len(place) - 1)
        full = (last < len(place)) & (item[end] == item) & (text[place[end]] == text[place]) & (place[end] - place < span[item])
        edges = np.bincount(np.flatnonzero(full), minlength=len(place) + 1) - np.bincount(end[full] + 1, minlength=len(place) + 1)
        kept = np.cumsum(edges)[:-1] > 0
        if kept.any():
            yield place[kept], item[kept]
        again = (place > new_place[-1] - span[item]) & (needed[item] > 1)
        place, item = place[again], item[again]


def _seeds(items: Items, n: int, code: np.ndarray, text: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, items): where the texts hold enough rare n-grams or words of items; ``ends`` is where a place's text ends."""
    known = code >= 0
    whole = known[: max(0, len(code) - n + 1)].copy()
    for k in range(1, n):
        whole &= known[k : k + len(whole)]
    place = np.flatnonzero(whole)
    place = place[place + n <= ends[place]]
    gram = np.full(len(code), -1)
    if len(place) and len(items.grams):
        hashes = window_hashes(np.maximum(code, 0).astype(np.uint64), n)[place]
        at = np.minimum(np.searchsorted(items.grams, hashes), len(items.grams) - 1)
        gram[place] = np.where(items.grams[at] == hashes, at, -1)
    words, grams = _ranked(items, items.codes, len(items.vocabulary), code), _ranked(items, items.gram_at, len(items.grams), gram)
    many_grams, needed_grams, many_words, needed_words = _chosen(items, words, grams, n, len(code))
    yield from _together(_met(*grams.rarest(many_grams), len(items.grams), gram), needed_grams, items.span, text)
    yield from _together(_met(*words.rarest(many_words), len(items.vocabulary), code), needed_words, items.span, text)


def _best_sum(gains: np.ndarray) -> np.ndarray:
    """The largest sum of consecutive values of each row, 0 at the least."""
    sums = np.pad(np.cumsum(gains, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
    return (sums - np.minimum.accumulate(sums, axis=1)).max(1)


def _finder(wanted, n: int):
    """Aligns documents with items: the best alignment of each passage that reaches the least score of its item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = wanted.value
        local = np.full(len(items.vocabulary) + 1, -1, np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                words, rows = _words(part.column("text")), []
                code = pc.fill_null(pc.index_in(words.distinct, value_set=items.vocabulary), -1).to_numpy().astype(np.int64)[words.codes]
                text = np.repeat(np.arange(len(part)), np.diff(words.bounds))
                ids = part.column("doc_id").to_pylist()
                for place, item in _seeds(items, n, code, text, words.bounds[1:][text]):
                    order = np.lexsort((place, item))
                    place, item = place[order], item[order]
                    span = items.span[item]
                    new = np.r_[True, (np.diff(item) > 0) | (np.diff(text[place]) != 0) | (np.diff(place) > 2 * span[1:])][: len(place)]
                    first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(place)] - 1
                    begin = np.maximum(words.bounds[text[place[first]]], place[first] - span[first])
                    end = np.minimum(words.bounds[text[place[first]] + 1], place[last] + span[first])
                    for own in np.split(np.arange(len(first)), np.flatnonzero(np.diff(item[first])) + 1):
                        if not len(own):
                            continue
                        i = item[first[own[0]]]
                        mine, inverse = np.unique(items.codes[items.bounds[i] : items.bounds[i + 1]], return_inverse=True)
                        local[mine] = np.arange(len(mine))
                        own = own[np.argsort(end[own] - begin[own], kind="stable")]
                        while len(own):
                            size = end[own] - begin[own]
                            some = max(1, int(np.searchsorted(size * np.arange(1, len(own) + 1), CHUNK, side="right")))
                            now, size, own = own[:some], size[:some], own[some:]
                            offset = np.arange(size[-1])
                            at = begin[now][:, None] + offset
                            passage = np.where(offset < size[:, None], local[code[np.minimum(at, len(code) - 1)]], -1)
                            held = np.zeros((some, len(mine) + 1), bool)
                            held[np.arange(some)[:, None], passage] = True
                            bound = np.minimum(_best_sum(np.where(passage >= 0, MATCH, MISMATCH)), _best_sum(np.where(held[:, inverse], MATCH, MISMATCH)))
                            left = np.flatnonzero(bound >= items.least[i])
                            score, stop = align_all(inverse, passage[left])
                            for k in np.flatnonzero(score >= items.least[i]):
                                a = begin[now[left[k]]]
                                rows.append((ids[text[a]], items.ids[i], len(inverse), int(score[k]), int(a - words.bounds[text[a]] + stop[k])))
                        local[mine] = -1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "item_words", "score", "end_word"])

    return run


def align_all(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ends): the best local alignment of word numbers with each row of ``passages``, and where it ends in the row.

    Numbers of no word of the item match nothing. A row of each table is a vector: gaps
    along it are a running maximum of the scores raised by their place.
    """
    steps = np.arange(passages.shape[1], dtype=np.int32) * -GAP
    row = np.zeros(passages.shape, np.int32)
    best, end = np.zeros(len(passages), np.int32), np.zeros(len(passages), np.int64)
    for word in item if passages.size else ():
        diagonal = np.where(passages == word, np.int32(MATCH), np.int32(MISMATCH))
        diagonal[:, 1:] += row[:, :-1]
        row = np.maximum(np.maximum(diagonal, row + np.int32(GAP)), 0)
        row = np.maximum.accumulate(row + steps, axis=1) - steps
        k = row.argmax(1)
        top = row[np.arange(len(row)), k]
        end = np.where(top > best, k + 1, end)
        best = np.maximum(best, top)
    return best, end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """:func:`align_all` for one passage."""
    best, end = align_all(item, passage[None])
    return int(best[0]), int(end[0])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = 3, similarity: float = 0.5, long_score: int = 100, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, item_words, score, similarity, end_word) of documents that hold a copy of a test item.

    ``similarity`` is the alignment's score over that of an exact copy; a pair is
    returned if it reaches the limit, or if the score reaches ``long_score`` (50 equal
    words on end), so that part of a long item counts too. ``end_word`` is the word of
    the document after the alignment. Of several passages the best counts, then the first.

    Null or empty texts on either side match nothing, nor do items with fewer than ``n``
    words. Rows with one doc_id or item_id count as one document or item. Empty tables
    give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    items = written(item_words(benchmark, item_id_col, item_text_col).where(F.col("n_words") >= n), "items")
    size = items.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).collect()[0]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    blocks = max(1, -(-size.words // BLOCK_GRAMS))
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).distinct()
        rows = [(r.item_id, r.words) for r in own.select("item_id", "words").collect()]
        wanted = spark.sparkContext.broadcast(prepared(rows, n, similarity, long_score))
        aligned = texts.mapInArrow(_finder(wanted, n), "doc_id long, item_id long, item_words long, score long, end_word long")
        found = aligned if found is None else found.unionByName(aligned)
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("item_words", "score", "end_word"), F.struct("score", -F.col("end_word"))).alias("b")).select("doc_id", "item_id", "b.*")
    best = best.withColumn("similarity", F.col("score") / (MATCH * F.col("item_words")))
    return best.where((F.col("similarity") >= similarity) | (F.col("score") >= long_score)).select("doc_id", "item_id", "item_words", "score", "similarity", "end_word")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of an item of ``benchmark``."""
    return contaminated(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")])
