"""Source divergence audit: term counts by fixed-width digests, strings joined back at the end.

Counts of terms by language and source are shuffled under 16 bytes of digest, never under
the term. A second aggregation keeps the minimum and the maximum string of each kept
digest: where they differ, more than one term shares the digest, and the digest is split
by a further hash and counted anew. All later joins, sums and first cuts use digests;
strings are joined to the few rows that are returned. Pairs of sources are compared in
tiles of bounded numbers of sources and terms, which return one sum for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retort.llm.scratch import written
from retort.llm.words import Words, byte_table, slices, split_words, translated

#: Letters and characters beyond ASCII make terms.
_TABLE = byte_table("abcdefghijklmnopqrstuvwxyz")
#: A tile holds about so many terms and so many sources a side.
TILE_TERMS, TILE_SOURCES = 1024, 128
#: Split digests that a task is sent at most; if there are more, every digest is as wide as a split one.
MOST_SPLIT = 10_000
#: Bytes of text that are counted at once.
SLICE = 6 << 20
#: The unit of shares.
UNIT = 1_000_000_000


class Splits:
    """Which digests are split, by which seed; ``every`` is the seed by which all are, or 0."""

    def __init__(self, bits: int = 64) -> None:
        self.bits, self.seeds, self.every = bits, {}, 0

    def digests(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): a term's digest, and its second part, which is 0 unless the digest is split."""
        mask = np.uint64(2**self.bits - 1)
        low = (np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms)) & mask).view(np.int64)
        high = np.zeros(len(terms), np.int64)
        if self.every or self.seeds:
            for k, d in enumerate(low.tolist()):
                seed = max(self.every, self.seeds.get(d, 0))
                if seed:
                    high[k] = np.uint64(xxhash.xxh3_64_intdigest(terms[k], seed) | 1).astype(np.int64)
        return low, high


def _terms(part: pa.RecordBatch) -> Words:
    return split_words(translated(part.column("text"), _TABLE))


def _counter(splits: Splits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, source, low, high, n, docs) of each slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = _terms(part)
                if not len(words.codes):
                    continue
                low, high = splits.digests(words.distinct.to_pylist())
                names = [part.column(c).dictionary_encode() for c in ("lang", "source")]
                lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
                group, group_of = np.unique(lang * len(names[1].dictionary) + source, return_inverse=True)
                size = len(words.distinct)
                own, n = np.unique(np.repeat(np.arange(len(part)), np.diff(words.bounds)) * size + words.codes, return_counts=True)
                cell, at = np.unique(group_of[own // size] * size + own % size, return_inverse=True)
                of, term = group[cell // size], cell % size
                yield pa.RecordBatch.from_arrays(
                    [
                        names[0].dictionary.take(pa.array(of // len(names[1].dictionary))), names[1].dictionary.take(pa.array(of % len(names[1].dictionary))),
                        pa.array(low[term]), pa.array(high[term]), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64)),
                    ],
                    ["lang", "source", "low", "high", "n", "docs"],
                )

    return run


def _speller(splits: Splits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(low, high, term) of the distinct terms of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                distinct = _terms(part).distinct
                low, high = splits.digests(distinct.to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), distinct], ["low", "high", "term"])

    return run


def counted_terms(texts: DataFrame, least_docs: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(cells, spelling), both written, of (lang, source, text) rows.

    ``cells`` (lang, source, low, high, n, lang_n) are the counts of the terms that their
    language keeps; ``spelling`` (low, high, term) has the string of each kept digest.
    """
    splits = Splits(bits)
    for turn in range(1, 12):
        counts = texts.mapInArrow(_counter(splits), "lang string, source string, low long, high long, n long, docs long")
        counts = written(counts.groupBy("lang", "source", "low", "high").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
        kept = counts.groupBy("lang", "low", "high").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        kept = written(kept.select("lang", "low", "high", "lang_n"), "kept")
        spelled = texts.select("text").mapInArrow(_speller(splits), "low long, high long, term string").groupBy("low", "high").agg(F.min("term").alias("term"), F.max("term").alias("last"))
        spelled = written(spelled.join(kept.select("low", "high").distinct(), ["low", "high"]), "spelled")
        clash = spelled.where("term <> last").select("low").distinct()
        found = [r.low for r in clash.limit(MOST_SPLIT + 1).collect()]
        if not found:
            return written(counts.drop("docs").join(kept, ["lang", "low", "high"]), "cells"), spelled.select("low", "high", "term")
        if len(found) > MOST_SPLIT:
            splits.every = turn
        splits.seeds |= dict.fromkeys(found, turn)
        if len(splits.seeds) > 4 * MOST_SPLIT:
            splits.seeds, splits.every = {}, turn
    raise RuntimeError("digests stay shared after eleven hashes")


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)); null where there are no terms."""
    return F.expr(f"1 + (cast({n} + 2 AS decimal(22, 0)) * cast({UNIT} AS decimal(10, 0))) div nullif({total} + 2 * {terms}, 0)")


def _difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value) of the pairs of one tile: differences over its terms, less those of terms that neither source has."""
    head, cell = frame[frame["head"]], frame[~frame["head"]]
    diagonal = bool(frame["row"].iloc[0] == frame["col"].iloc[0])
    places, term = np.unique(cell[["low", "high"]].to_numpy(np.int64), axis=0, return_inverse=True)
    sides = []
    for side in (0, 0 if diagonal else 1):
        own, rows = head[head["side"] == side].sort_values("source"), (cell["side"] == side).to_numpy()
        place = pd.Series(np.arange(len(own)), index=own["source"].to_numpy())
        base = own["p"].to_numpy(np.int64)
        shares = np.repeat(base[:, None], len(places), 1)
        shares[place.loc[cell["source"].to_numpy()[rows]].to_numpy(np.int64), term[rows]] = cell["p"].to_numpy(np.int64)[rows]
        sides.append((own["source"].to_numpy(), base, own["terms"].to_numpy(np.int64), shares))
    (a, a_base, terms, x), (b, b_base, _, y) = sides
    left, right, values = [], [], []
    for i in range(len(a)):
        first = i + 1 if diagonal else 0
        none = (a_base[i] - b_base[first:]) ** 2 // (a_base[i] + b_base[first:])
        values.append(((x[i] - y[first:]) ** 2 // (x[i] + y[first:])).sum(1) + (terms[i] - len(places)) * none)
        left.append(np.full(len(none), i))
        right.append(np.arange(first, len(b)))
    left, right, values = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (left, right, values))
    return pd.DataFrame({"lang": [frame["lang"].iloc[0]] * len(left), "a": a[left], "b": b[right], "value": values}).astype({"lang": object, "a": object, "b": object})


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language, both ways round.

    ``cells`` are (lang, source, low, high, p), ``groups`` (lang, source, base, terms) with
    the share of a term that the group lacks. Each tile takes the terms that neither side
    has as all ``terms`` of its own block, so their number is corrected by block.
    """
    blocks = groups.groupBy("lang").agg(F.expr(f"int(ceil(count(*) / {TILE_SOURCES}))").alias("across"), F.expr(f"int(greatest(1, ceil(max(terms) / {TILE_TERMS})))").alias("deep"))
    deal = groups.join(blocks, "lang").withColumn("own", F.expr("int(pmod(xxhash64(source), across))"))
    head = deal.select("lang", "source", "own", "across", F.explode(F.expr("sequence(0, deep - 1)")).alias("block"), F.col("base").alias("p"), "terms", "deep")
    head = head.select("lang", "source", "own", "across", "block", F.lit(True).alias("head"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), "p", F.expr("if(block = 0, terms, 0L)").alias("terms"))
    own = cells.join(deal.select("lang", "source", "own", "across", "deep"), ["lang", "source"])
    own = own.select("lang", "source", "own", "across", F.expr("int(pmod(xxhash64(low, high), deep))").alias("block"), F.lit(False).alias("head"), "low", "high", "p", F.lit(0).cast("long").alias("terms"))
    sent = head.unionByName(own).withColumn("other", F.explode(F.expr("sequence(0, across - 1)")))
    sent = sent.select("lang", "block", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), F.expr("int(own > other)").alias("side"), "head", "source", "low", "high", "p", "terms")
    sums = sent.groupBy("lang", "block", "row", "col").applyInPandas(_tile, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = written(sums, "pairs")
    return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def audit(docs: DataFrame, *, least_docs: int = 10, top: int = 10, bits: int = 64, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """How unlike the sources of each language are, and by which terms a source stands out from its language.

    A language keeps the terms of at least ``least_docs`` of its documents. Returns lang,
    source, part, item, value and rank. Part ``pair``: item is each other source of the
    language, value the sum of the differences over all kept terms, at every rank. Part
    ``term``: the ``top`` kept terms that the source has more of than its language. Ranks
    go from 1 by value, descending, then by item in the order of its bytes.

    A null text, language or source is an empty string; a source without terms has its
    pairs, a language without kept terms has pairs of value 0. Repeated rows count each.
    An empty table gives an empty result and other columns are not read. ``bits`` of a
    term's digest are used; fewer give the same result by more splits.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    cells, spelling = counted_terms(texts, least_docs, bits)
    langs = cells.select("lang", "low", "high", "lang_n").distinct().groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])
    groups = written(groups.withColumn("base", F.coalesce(_share("0", "total", "terms"), F.lit(1).cast("long"))), "groups")
    full = cells.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms")).withColumn("q", _share("lang_n", "lang_total", "terms"))
    full = written(full.select("lang", "source", "low", "high", "p", "q"), "shares")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    best = full.where("p > q").withColumn("value", _difference("p", "q")).withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top)
    terms = best.select("lang", "source", "low", "high", "value").join(spelling, ["low", "high"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    pairs = _pairs(full.drop("q"), groups.select("lang", "source", "base", "terms")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranks = lambda t: t.withColumn("rank", F.row_number().over(order))
    return ranks(terms).where(F.col("rank") <= top).unionByName(ranks(pairs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of all ``documents``, language by language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cnt GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p,
         1 + 1000000000::HUGEINT * (k.lang_n + 2) // (l.total + 2 * l.v) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""
