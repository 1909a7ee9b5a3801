"""Source divergence against plain Python, with narrow digests that collide and with small tiles."""

import random
import re
from collections import Counter, defaultdict

import pytest

from retort.llm import divergence_audit as A

SCHEMA = "text string, lang string, source string, term string, rank int"


def brute(rows, least=10, top=10):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low))
        n[lang, source] += terms
        df[lang] += Counter(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]
        v = len(kept)

        def shares(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept)
            return [1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * v) for t in kept]

        whole = shares(sum((n[lang, s] for s in sources), Counter()))
        own = {s: shares(n[lang, s]) for s in sources}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(map(f, own[s], own[o])), o) for o in sources - {s}]
            terms = [(f(p, q), t) for p, q, t in zip(own[s], whole, kept, strict=True) if n[lang, s][t] and p > q]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, x, k + 1) for k, (x, o) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def got(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect())


def some_rows(seed, sources=9):
    r = random.Random(seed)
    words = [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Über", "日本", "ÉCOLE", "a1b", "x" * 3000]
    rows = []
    for k in range(400):
        s = min(int(r.expovariate(0.4)), sources - 1)
        rows.append((" ".join(r.choice(words[: 40 + 9 * s]) for _ in range(r.randrange(0, 30))), r.choice(["en", "de", "en", None]), f"s{s}"))
    rows += [(None, "en", None), ("", "en", "empty"), ("12 34 !", "fr", "only"), ("rare words here", "it", "a"), ("rare words there", "it", "b"), ("tie " * 20_000, "en", "s1")]
    return rows + [("same row same row", "en", "s2")] * 40


@pytest.mark.parametrize("bits", [64, 5])
def test_against_plain_python(spark, monkeypatch, bits):
    monkeypatch.setattr(A, "TILE_TERMS", 16)
    monkeypatch.setattr(A, "TILE_SOURCES", 3)
    rows = some_rows(bits)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    assert got(A.audit(docs, bits=bits)) == brute(rows)


def test_more_shared_digests_than_are_sent_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(A, "MOST_SPLIT", 3)
    rows = some_rows(3)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(A.audit(docs, bits=4, top=3)) == brute(rows, top=3)


def test_empty_table_and_no_kept_terms(spark):
    docs = spark.createDataFrame([("a b", "en", "x", "", 1), ("c", "en", "y", "", 1)], SCHEMA)
    assert A.audit(docs.limit(0)).collect() == []
    assert got(A.audit(docs)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
