import base64
import json

import numpy as np
import pytest

from retort.llm import chat_format as C
from retort.llm import licenses as L
from retort.llm import secret_scan as S


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def rsa(n=9):
    return der(0x30, der(2, b"\0"), *[der(2, bytes([k + 1] * 40)) for k in range(n - 1)])


def token(alg="HS256", sign="c2ln"):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part({'alg': alg, 'typ': 'JWT'})}.{part({'sub': 'me'})}.{sign}"


def test_base_spans():
    text = 'é PASSWORD = "abc-123" token:short AKIA' + "Q" * 16 + " AKIA123 " + "0a" * 12 + " api_key='x" + "y" * 9 + "'"
    got = S.base_spans(text)
    assert [k for k, _, _ in sorted(got, key=lambda s: s[1])] == ["assign", "access", "hex", "assign"]
    assert text[got[0][1] : got[0][2]] == 'PASSWORD = "abc-123'


def test_keys_are_confirmed_by_structure():
    key = rsa()
    assert S.private_der(key) and not S.private_der(key[:-1]) and not S.private_der(key + b"\0") and not S.private_der(rsa(5))
    ec = der(0x30, der(2, b"\1"), der(4, b"k" * 32))
    assert S.private_der(ec) and S.private_der(der(0x30, der(2, b"\0"), der(0x30, der(6, b"abc")), der(4, ec)))
    word = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + word(b"none") + word(b"none") + word(b"") + (1).to_bytes(4, "big") + word(b"public") + word(b"private part")
    assert S.private_ssh(ssh) and not S.private_ssh(ssh + b"x")


@pytest.mark.parametrize("form,kind", [("plain", "key"), ("url", "key"), ("hex", "hexkey"), ("pem", "pem")])
def test_encoded_keys_are_found(form, kind):
    key = rsa()
    body = {"plain": base64.b64encode(key), "url": base64.urlsafe_b64encode(key), "hex": key.hex().upper().encode(), "pem": b"-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(key) + b"-----END PRIVATE KEY-----"}[form].decode()
    text = f"né {body} end"
    assert (kind, 3, 3 + len(body)) in S.secret_spans(text)
    assert body not in S.redacted(text)


def test_tokens():
    good = token()
    assert ("token", 4, 4 + len(good)) in S.secret_spans("see " + good)
    assert not S.signed_token(token(sign="")) and S.signed_token(token("none", "")) and not S.signed_token("eyJhbGciOjF9.e30.c2ln")
    assert S.secret_spans(None) == [] and S.secret_spans("") == [] and S.secret_spans("QUJD" * 30) == []


def test_columns(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "token=" + "x" * 8)], "doc_id long, text string")
    got = {r.doc_id: r for r in docs.select("doc_id", S.find_secrets("text").alias("s"), S.redact_secrets("text").alias("t")).collect()}
    assert got[1].s == [] and got[1].t is None and got[2].t == "" and got[3].t == "[assign removed]" and got[3].s[0].end == 14


def test_licences(spark):
    mit = next(t for n, t in L.KNOWN if n == "MIT" and len(t) > 200)
    noisy = "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sublicence").upper().replace(",", " ,")
    rows = [(1, noisy), (2, "prose\nreleased under the mit license\nmore"), (3, "We discuss the MIT License here."), (4, None), (5, ""), (6, "intro\n\n" + mit + "\n\nend"), (7, "Copyright 2021 X")]
    got = sorted((r.doc_id, r.unit, r.unit_no, r.license) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), L.default_known(spark)).collect())
    assert (1, "document", 0, "MIT") in got and (2, "line", 1, "MIT") in got and (6, "paragraph", 1, "MIT") in got
    assert {g[0] for g in got} == {1, 2, 6}
    assert L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), L.default_known(spark).limit(0)).collect() == []


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    model = np.log(r.random((C.STATES, 1 + C.STATES + C.SYMBOLS)))
    symbols = r.integers(0, C.SYMBOLS, 4)
    step, seen = model[:, 1 : 1 + C.STATES], model[:, 1 + C.STATES :]

    def value(p):
        return model[p[0], 0] + sum(step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(seen[s, o] for s, o in zip(p, symbols, strict=True))

    best = max(np.ndindex(*[C.STATES] * 4), key=value)
    assert tuple(C.viterbi(model, symbols)) == best


def test_chats_in_blocks_and_odd_rows(spark, monkeypatch):
    rows = [(c, t, ("user", "assistant")[t % 2], ("User: q?", "Assistant: a long answer\nwith lines")[t % 2]) for c in range(3) for t in range(9)]
    rows += [(50, 0, "user", None), (None, 0, "user", "User: hi"), (51, None, None, "Assistant: <|x|>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = sorted(map(str, C.format_chats(turns).collect()))
    monkeypatch.setattr(C, "BLOCK_LINES", 2)
    assert sorted(map(str, C.format_chats(turns).collect())) == one
    assert any("<|user|>\\nq?\\n<|end|>" in x for x in one) and any("< |x|>" in x for x in one)
    assert C.format_chats(turns.limit(0)).collect() == []


def test_symbols_do_not_show_where_rows_begin(spark, monkeypatch):
    texts = ["User: why?", "Assistant: so\n\nand so", "plain\n", "after a blank", "more\nlines"]
    rows = [(c, t, None, x) for c in (1, 2) for t, x in enumerate(texts)] + [(c, 0, None, "\n".join(texts)) for c in (11, 12)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (512, 2):
        monkeypatch.setattr(C, "BLOCK_LINES", block)
        seen = {}
        for x in sorted(C.as_lines(turns).collect(), key=lambda x: (x.conv_id, x.turn, x.k)):
            seen.setdefault(x.conv_id, []).append(x.symbol)
        assert seen[1] == seen[2] == seen[11] == seen[12]
        assert [x % 2 for x in seen[1]] == [1, 0, 0, 1, 0, 0, 1, 0, 0]


def test_folds_are_decoded_by_the_others_model(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(C, "fit", lambda lines, own=C.fit: fitted.append({r.conv_id for r in lines.select("conv_id").distinct().collect()}) or own(lines))
    decoded = []
    monkeypatch.setattr(C, "decode", lambda lines, model, own=C.decode: decoded.append({r.conv_id for r in lines.select("conv_id").distinct().collect()}) or own(lines, model))
    rows = [(c, t, ("user", "assistant")[t % 2], ("User: q?", "Assistant: a long answer\nwith lines")[t % 2]) for c in range(12) for t in range(4)]
    got = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), folds=2).collect()
    assert len(fitted) == len(decoded) == 2 and set.union(*decoded) == set(range(12)) and all(f and f == set(range(12)) - d for f, d in zip(fitted, decoded, strict=True))
    assert len(got) == 48 and all(x.n_right == x.n_lines for x in got)
