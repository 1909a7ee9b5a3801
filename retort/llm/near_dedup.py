"""MinHash near-duplicate search by a signature-coordinate inverted join.

Every text becomes a set of word shingles and a MinHash signature. A document is posted
under each coordinate-value pair of its signature. Pairs that only one text has cannot
meet anything and are skipped; of the rest a document keeps its prefix, the rarest
``coordinates - matches + 1`` pairs in one global order by frequency: two signatures that
agree in ``matches`` places share a pair within their prefixes. Candidates that collide
in fewer than ``matches`` places are merged away, and the others are confirmed on the
full shingle sets.

No bucket emits all its pairs. First each bucket links its members to its most central
one; then only members that are not yet linked to the same one are compared, small
buckets in a join, large ones (over ``TILE_FROM`` members) in tiles of bounded bytes that
return a spanning forest of their links. Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.components import connected_components
from retort.llm.scratch import written
from retort.llm.words import mix, shingle_sets, slices, split_words

#: Buckets with more members than this are compared in tiles.
TILE_FROM = 64
#: A side of a tile holds at most so many members and, unless one text is larger, bytes of shingles.
TILE_ROWS, TILE_BYTES = 1024, 24 << 20

_KEYS = np.random.default_rng(4).integers(0, 2**63, (64, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash values of one non-empty shingle set; each carries its coordinate's number in its bits."""
    least = [((shingles ^ x) * y).min() for x, y in _KEYS[:coordinates]]
    return mix(np.array(least, np.uint64) + np.arange(coordinates, dtype=np.uint64))


def _sketcher(n: int, coordinates: int, lower: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(split_words(part.column("text"), lower), n)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                signatures = [signature(s, coordinates).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.r_[0, np.cumsum([len(s) for s in signatures])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signatures), pa.int64())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "digest", "signature"],
                )

    return run


def _setter(n: int, lower: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(split_words(part.column("text"), lower), n)]
                same = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(sets, pa.binary())], ["digest", "shingles"]).filter(same)

    return run


def _confirmer(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs whose shingle sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tiler(percent: int, matches: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between unlike labels in one tile, as a spanning forest."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in tile["shingles"]]
        size = np.array([len(s) for s in sets])
        joined, starts = np.concatenate(sets), np.r_[0, np.cumsum(size)[:-1]]
        values, codes = np.unique(joined, return_inverse=True)
        signatures = np.stack([np.asarray(s) for s in tile["signature"]])
        root = pd.factorize(tile["label"].map(bytes))[0]
        diagonal = bool(tile["diagonal"].iloc[0])
        left = np.flatnonzero(tile["side"].to_numpy() == 0)
        right = left if diagonal else np.flatnonzero(tile["side"].to_numpy() == 1)
        seen = np.zeros(len(values), bool)
        links: list[tuple[int, int]] = []
        for a in left:
            others = right[(root[right] != root[a]) & (100 * np.minimum(size[right], size[a]) >= percent * np.maximum(size[right], size[a]))]
            if diagonal:
                others = others[others > a]
            others = others[(signatures[others] == signatures[a]).sum(1) >= matches]
            if not len(others):
                continue
            mine = codes[starts[a] : starts[a] + size[a]]
            seen[mine] = True
            for b in others:
                if root[a] != root[b]:
                    both = int(seen[codes[starts[b] : starts[b] + size[b]]].sum())
                    if 100 * both >= percent * (size[a] + size[b] - both):
                        links.append((a, b))
                        root[root == root[b]] = root[a]
            seen[mine] = False
        name = tile["digest"].to_numpy()
        return pd.DataFrame({"a": [bytes(name[a]) for a, _ in links], "b": [bytes(name[b]) for _, b in links]}, columns=["a", "b"])

    return run


def _sizes_fit(x: str, y: str, percent: int) -> Column:
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def links(texts: DataFrame, sketch: DataFrame, shingle: int, percent: int, coordinates: int, matches: int, lower: bool) -> DataFrame:
    """Confirmed links (a, b) between digests of unlike shingle sets; enough of them to connect all that are connected."""
    prefix = coordinates - matches + 1
    distinct = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
    )
    places = distinct.select("digest", F.explode("signature").alias("element"))
    shared = places.join(places.groupBy("element").agg(F.count("*").alias("df")).where("df > 1"), "element")
    ranked = shared.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("found"), F.sum("df").alias("central"))
    ranked = ranked.select(
        "digest", "central", F.expr(f"transform(slice(found, 1, greatest(0, {prefix} - ({coordinates} - size(found)))), x -> x.element)").alias("prefix")
    ).where(F.size("prefix") > 0)
    active = written(ranked.join(distinct, "digest"), "active")
    posts = active.select("digest", "n", "central", F.explode("prefix").alias("element"))
    buckets = posts.groupBy("element").agg(F.count("*").alias("members"), F.max_by(F.struct("digest", "n"), F.struct("central", "digest")).alias("hub")).where("members > 1")
    posts = written(posts.join(buckets, "element").select("element", "digest", "n", "members", "hub"), "posts")

    wanted = posts.select("digest").distinct().join(active.select("digest", "doc_id"), "digest")
    found = texts.where("text IS NOT NULL").join(wanted, "doc_id").groupBy("doc_id", "digest", F.xxhash64("text").alias("text_key")).agg(F.first("text").alias("text"))
    sets = written(found.select("digest", "text").mapInArrow(_setter(shingle, lower), "digest binary, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles")), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("shingles_a")), "a").join(
            sets.select(F.col("digest").alias("b"), F.col("shingles").alias("shingles_b")), "b"
        )
        return both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_confirmer(percent), "a binary, b binary")

    to_hub = posts.where(F.col("hub.digest") != F.col("digest")).where(_sizes_fit("n", "hub.n", percent)).select(F.col("hub.digest").alias("a"), F.col("digest").alias("b")).distinct()
    first = written(confirmed(to_hub), "first")

    labels = first.groupBy(F.col("b").alias("digest")).agg(F.min("a").alias("linked"))
    labelled = posts.join(labels, "digest", "left").select("element", "digest", "n", "members", F.coalesce("linked", "digest").alias("label"))
    mixed = labelled.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("element")
    rest = written(labelled.join(mixed, "element"), "rest").join(active.select("digest", "signature", "prefix"), "digest")

    small = rest.where(F.col("members") <= TILE_FROM)
    x, y = (small.select("element", *[F.col(c).alias(f"{c}_{s}") for c in ("digest", "n", "label", "signature", "prefix")]) for s in "xy")
    pairs = x.join(y, "element").where(
        (F.col("digest_x") < F.col("digest_y"))
        & (F.col("label_x") != F.col("label_y"))
        & _sizes_fit("n_x", "n_y", percent)
        & (F.expr("aggregate(zip_with(signature_x, signature_y, (p, q) -> int(p = q)), 0, (s, v) -> s + v)") >= matches)
        & (F.element_at(F.array_intersect("prefix_x", "prefix_y"), 1) == F.col("element"))
    )
    second = confirmed(pairs.select(F.col("digest_x").alias("a"), F.col("digest_y").alias("b")))
    return first.unionByName(second).unionByName(_tiles(rest.where(F.col("members") > TILE_FROM), sets, percent, matches))


def _tiles(rest: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Links within large buckets: their members are dealt to blocks by hash, and each pair of blocks is a tile."""
    full = rest.join(sets, "digest")
    weight = full.groupBy("element").agg(F.expr(f"int(greatest(ceil(count(*) / {TILE_ROWS}), ceil(sum(length(shingles)) / {TILE_BYTES})))").alias("blocks"))
    dealt = full.join(weight, "element").withColumn("block", F.expr("int(pmod(xxhash64(digest), blocks))"))
    tiles = dealt.select(
        "element", "digest", "label", "signature", "shingles", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    ).select(
        "element", "digest", "label", "signature", "shingles",
        F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"),
        (F.col("block") == F.col("other")).alias("diagonal"), F.expr("int(block > other)").alias("side"),
    )
    return tiles.groupBy("element", "row", "col").applyInPandas(_tiler(percent, matches), "a binary, b binary")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, coordinates: int, matches: int, lower: bool) -> DataFrame:
    """Each row's doc_id, text_key (the text's MD5), n_shingles, and its component as digest and as smallest doc_id."""
    if not 0 < matches <= coordinates <= len(_KEYS):
        raise ValueError("0 < matches <= coordinates <= 64 is needed")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = texts.withColumn("text_key", F.unhex(F.md5("text")))
    sketch = written(keyed.mapInArrow(_sketcher(shingle, coordinates, lower), "doc_id long, text_key binary, n_shingles long, digest binary, signature array<long>"), "sketch")
    edges = links(texts, sketch, shingle, percent, coordinates, matches, lower)
    own = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    reach = connected_components(edges, "a", "b").select(F.col("node").alias("digest"), "component")
    grouped = own.join(reach, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    owner = grouped.join(least, "component").select("digest", "component", "component_id")
    return sketch.select("doc_id", "text_key", "n_shingles", "digest").join(owner, "digest", "left")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, coordinates: int = 16, matches: int = 4, lower: bool = True
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard index of ``percent`` / 100 or more.

    Returns one row for each input row: doc_id, n_shingles, component_id (the smallest
    doc_id that is reachable, its own included) and kept (doc_id = component_id).

    ``shingle`` words make a shingle; a text with fewer words is one shingle; ``lower``
    maps A-Z to a-z. With 16 coordinates and 4 matches a link of exactly 0.8 stays
    unseen with a chance of 3e-7, one of 0.85 with 5e-9; what is seen is confirmed on
    full sets.

    A row is a document: rows that share a doc_id are linked by their texts only, so
    that unlike texts under one doc_id may be in unlike components. Null or wordless
    texts are linked with nothing, not even with each other. A null doc_id is linked
    with nothing; its component_id is null and kept is true. An empty table gives an
    empty result; other columns are not read.
    """
    found = _classes(docs, id_col, text_col, shingle, percent, coordinates, matches, lower)
    found = found.withColumn("component_id", F.expr("CASE WHEN doc_id IS NOT NULL THEN if(n_shingles > 0, component_id, doc_id) END"))
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, coordinates: int = 16, matches: int = 4, lower: bool = True
) -> DataFrame:
    """The rows of ``docs`` with one row for each component: that of the smallest doc_id, then of the smallest MD5 of the text.

    Every text of ``docs`` is thus near to one that stays, also where unlike texts share
    a doc_id. Rows of one doc_id and text come down to one: the least by the hash of all
    columns, so that a rerun keeps the same. Rows without words or with a null doc_id
    are linked with nothing; of those that share doc_id and text, too, one stays, but
    null ids all stay. Rows are taken away by an anti join with the narrow table of
    removed (doc_id, text) keys.
    """
    found = written(_classes(docs, id_col, text_col, shingle, percent, coordinates, matches, lower).where("doc_id IS NOT NULL"), "components")
    own = [F.col(f"_docs.{id_col}").cast("long") == F.col("_k.doc_id"), F.unhex(F.md5(F.col(f"_docs.{text_col}"))).eqNullSafe(F.col("_k.text_key"))]
    linked = found.where("n_shingles > 0")
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("_f"))
    gone = linked.join(first, "component").where("NOT (doc_id = _f.doc_id AND text_key = _f.text_key)").select("doc_id", "text_key").distinct().alias("_k")
    left = docs.alias("_docs").join(gone, own, "left_anti")
    again = written(found.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "again")
    if again.isEmpty():
        return left
    parted = left.alias("_docs").join(again.alias("_k"), own, "left_anti")
    names = [f"_c{k}" for k in range(len(docs.columns))]
    repeated = left.alias("_docs").join(again.alias("_k"), own, "left_semi").toDF(*names)
    keys = [F.col(names[docs.columns.index(c)]) for c in (id_col, text_col)]
    once = repeated.groupBy(*[k.alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*names), F.xxhash64(F.to_json(F.struct(*names)))).alias("_r"))
    return parted.unionByName(once.select(*[F.col("_r").getField(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]))


def query(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles of the whole texts of ``documents``, linked from 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=80)
