"""Canonical forms word by word, whole licence texts from files, and both sides of the anchor switch."""

import re

import pytest

from retort.llm import licenses as L


def form(text):
    text = "\n".join(x for x in text.lower().split("\n") if not re.match(r"[^\w]*(copyright\b|©|\(c\)\s*(copyright\b|\d{4}))", x))
    return " ".join(L.SPELLINGS.get(w, w) for w in re.sub(r"[\W_]+", " ", text).split())


CASES = ["licence licence x licence", "A wilful, wilful: organisation", "Sub-license or sublicense; SUBLICENCE", "Copyright (c) me\nthe rest", "", " \n", "©\n", "ten percent = ten per cent", "https://a.b http"]


def test_canonical_forms_are_word_by_word(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(L.canonical(df.t)).collect()]
    assert got == [form(t) for t in CASES]
    assert got[0] == "license license x license" and got[2] == "sub license or sub license sub license"


@pytest.mark.parametrize("most", [64, 1])
def test_both_ways_past_the_anchors(spark, monkeypatch, most):
    """With and without the look for anchor words the units are the same: those whose canonical form is known."""
    monkeypatch.setattr(L, "MOST_ANCHORS", most)
    known = [(n, t) for n, t in L.KNOWN] + [("House", "Use it at your own\nrisque, wilful or not.")]
    texts = [t for _, t in known] + ["x\n\n" + t + "\n\ny" for _, t in known] + ["prose only", None, "", "x " * 50_000 + "\n\nUse it at your own risque; willful or NOT\n\n"]
    rows = [(k, t, 1, "d") for k, t in enumerate(texts)] + [(3, texts[3], 1, "d"), (None, texts[4], 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit int, digest string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.unit, r.unit_no, r.license) for r in L.scan_licenses(docs, spark.createDataFrame(known, "license string, text string")).collect())
    names = {}
    for n, t in known:
        names[form(t)] = min(n, names.get(form(t), n))
    want = []
    for i, t, _, _ in rows:
        units = [("document", 0, t)] if t else []
        units += [("paragraph", k, p) for k, p in enumerate(re.split(r"\n(?:[ \t\r]*\n)+", t or ""))] if t and re.search(r"\n(?:[ \t\r]*\n)+", t) else []
        units += [("line", k, x) for k, x in enumerate(t.split("\n"))] if t and "\n" in t else []
        want += [(i is None, i or 0, u, k, names[form(x)]) for u, k, x in units if form(x) in names]
    assert got == sorted(want) and len(got) > 2 * len(known)


def test_whole_texts_from_files(spark, tmp_path):
    (tmp_path / "My-License 1.0.txt").write_text("You may\n\nuse this licence.\n")
    docs = spark.createDataFrame([(1, "YOU MAY USE this license")], "doc_id long, text string")
    assert [r.license for r in L.scan_licenses(docs, L.read_known(spark, str(tmp_path))).collect()] == ["My-License 1.0"]
    assert L.scan_licenses(docs.limit(0), L.read_known(spark, str(tmp_path))).collect() == []


def test_whole_licence_texts_are_known_however_they_are_wrapped(spark):
    """Documents that are a licence's text under a copyright line, wrapped anew, in capitals, or within other paragraphs."""
    whole = {n: t for n, t in L.KNOWN if len(t) > 600}
    assert {"Apache-2.0", "MPL-2.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "MIT", "ISC"} <= whole.keys()
    rows, want = [], set()
    for k, (n, t) in enumerate(sorted(whole.items())):
        rows += [(10 * k, "Copyright (c) 2020 Some One\n" + t), (10 * k + 1, " ".join(t.upper().replace("LICENSE", "LICENCE").split())), (10 * k + 2, t + " One more clause.")]
        want |= {(10 * k, n)} | ({(10 * k + 1, n)} if not re.search(r"(?im)^\W*copyright", t) else set())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in L.scan_licenses(docs, L.default_known(spark)).where("unit = 'document'").collect()}
    assert got == want and len(want) > len(whole)
