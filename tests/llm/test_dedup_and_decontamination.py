import random
import re

import numpy as np
import pyarrow as pa
import pytest

from retort.llm import decontamination as D
from retort.llm import near_dedup as N
from retort.llm.components import connected_components
from retort.llm.words import shingle_sets, split_words

SCHEMA = "doc_id long, text string, hub string, digest string"


def brute(rows, n, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(r, base, copies, first_id):
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        out.append((first_id + k, " ".join(w)))
    return out


def test_matches_brute_force_with_a_large_group(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(90)]
    rows = family(r, base, 150, 1000)
    line = "a very common line that many texts share"
    rows += [(k, " ".join(f"x{r.randrange(10**5)}" for _ in range(r.randrange(0, 25))) + "\n" + line) for k in range(60)]
    rows += [(200 + k, t) for k, (_, t) in enumerate(rows[150:160])]
    rows += [(300, ""), (301, None), (302, " \t\n"), (303, "One two"), (304, "one TWO"), (305, "one two three")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in N.near_duplicates(docs, shingle=4).collect()}
    want = brute(rows, 4)
    assert {i: v[:2] for i, v in got.items()} == want
    assert all(k == (c == i) for i, (_, c, k) in got.items())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "", ""), (1, "a b c d e f", "", ""), (None, "a b c d e f", "", ""), (2, "a b c d e f", "", "")], SCHEMA)
    got = sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in N.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    left = N.without_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(x.doc_id or -1 for x in left.collect()) == [-1, 1]
    assert N.near_duplicates(docs.limit(0)).collect() == []


def test_unlike_texts_under_one_id_are_not_lost(spark):
    one, two, near = "a b c d e f g h", "p q r s t u v w", "p q r s t u v w x"
    rows = [(3, one), (5, one), (5, two), (7, two), (7, two), (9, near), (9, "k l m n o p"), (11, ""), (11, ""), (11, None), (None, one)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, f"l{k}", "y") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in N.near_duplicates(docs).collect() if x.doc_id), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False), (9, 9, True), (11, 11, True), (11, 11, True), (11, 11, True)], key=str)
    left = sorted(((x.doc_id, x.text) for x in N.without_near_duplicates(docs).collect()), key=str)
    assert left == sorted([(3, one), (5, two), (9, "k l m n o p"), (11, ""), (11, None), (None, one)], key=str)


def test_two_near_texts_of_one_id_leave_one(spark):
    docs = spark.createDataFrame([(4, "a b c d e f g h i j k l m", "", ""), (4, "a b c d e f g h i j k l m n", "", ""), (8, "a b c d e f g h i j k l m", "", "")], SCHEMA)
    assert [x.doc_id for x in N.without_near_duplicates(docs).collect()] == [4]


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_words():
    w = split_words(pa.array(["  a b\x0bc ", None, "", "\x1cq \xa0z"]))
    assert list(w.bounds) == [0, 3, 3, 3, 5] and w.distinct.to_pylist() == ["a", "b", "c", "\x1cq", "\xa0z"]
    assert [len(s) for s in shingle_sets(w, 3)] == [1, 0, 0, 1]


def align_brute(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_is_smith_waterman():
    r = np.random.default_rng(0)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(0, 12)), r.integers(0, 4, r.integers(0, 15))
        assert D.align(a, b)[0] == align_brute(a, b)


@pytest.mark.parametrize("block", [1 << 21, 20])
def test_leaks_are_found_and_clean_documents_left(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_GRAMS", block)
    r = random.Random(5)
    word = lambda: f"v{r.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(25))) for k in range(6)] + [(90, "too short"), (91, None), (92, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    edited = items[2][1].split()
    edited[5], edited[12] = "other", "words"
    docs = [(k, filler(60)) for k in range(30)]
    docs += [(100 + k, f"{filler(30)}\n{items[1][1].upper()}, {filler(9)}") for k in range(40)]
    docs += [(200, filler(20) + " " + " ".join(edited) + " " + filler(20)), (201, items[3][1]), (202, None), (203, ""), (204, "too short")]
    got = {(x.doc_id, x.item_id) for x in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(100 + k, 1) for k in range(40)} | {(200, 2), (201, 3)}


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).collect() == [] and D.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []


def decontaminated_brute(docs, items, similarity=0.5):
    found = {}
    for i, t in docs:
        for j, u in items:
            a, b = t.split(), u.split()
            if len(b) >= 3 and (s := align_brute(b, a)) >= similarity * 2 * len(b):
                found[i, j] = s
    return found


@pytest.mark.parametrize("block", [1 << 21, 60])
def test_exact_and_edited_copies_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_GRAMS", block)
    r = random.Random(8)
    word = lambda: f"v{int(r.paretovariate(0.4)) % 900}"
    items = [(k, " ".join(word() for _ in range(r.choice((4, 9, 15, 25))))) for k in range(12)] + [(50, " ".join(f"u{k}" for k in range(25)))]
    docs = [(k, " ".join(word() for _ in range(50))) for k in range(20)]
    for k, (_, t) in enumerate(items):
        docs.append((100 + k, t))
        for e in range(6):
            w = t.split()
            for at in r.sample(range(len(w)), min(len(w) - 1, e + 1)):
                w[at] = r.choice((f"edit{r.randrange(999)}", f"{w[at]} more{r.randrange(999)}", ""))
            docs.append((1000 + 10 * k + e, " ".join([word() for _ in range(9)] + w + [word() for _ in range(9)])))
    broken = items[-1][1].split()
    for at in (5, 13, 20):
        broken[at] = "other"
    # No three words on end are left of these two.
    parted = " ".join(f"{w} x{k}" if k % 2 else w for k, w in enumerate(items[-1][1].split()))
    thirds = " ".join("y" if k % 3 == 2 else w for k, w in enumerate(items[-1][1].split()))
    docs += [(300, " ".join(broken)), (301, "a b c " + parted), (302, thirds + " a b")]
    want = decontaminated_brute(docs, items)
    assert {(300, 50): 41, (301, 50): 38, (302, 50): 26}.items() <= want.items()
    got = {(x.doc_id, x.item_id): x.score for x in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
