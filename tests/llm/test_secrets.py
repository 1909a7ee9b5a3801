"""Secret scans: keys in lines, behind prefixes and under headers; the whole query against plain patterns."""

import base64
import hashlib
import random
import re
import time
import textwrap

import pytest

from retort.llm import secret_scan as S
from test_scans import rsa, token


@pytest.fixture
def key():
    return base64.b64encode(rsa()).decode()


@pytest.mark.parametrize("width", [64, 76, 41])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
def test_keys_wrapped_into_lines(key, width, end):
    body = end.join(textwrap.wrap(key, width))
    text = f"né the key:\n{body}\nend of it"
    at = text.index(body)
    assert ("key", at, at + len(body)) in S.secret_spans(text) and key[:30] not in S.redacted(text)
    assert not [s for s in S.secret_spans(text.replace(body[4:8], "AAAA")) if s[0] == "key"]


@pytest.mark.parametrize("prefix", ["key_", "path/", "key-", "aMIb", "MIIEMIIE/"])
def test_keys_behind_a_prefix(key, prefix):
    text = f"see {prefix}{key} there"
    assert ("key", 4 + len(prefix), 4 + len(prefix) + len(key)) in S.secret_spans(text)


def test_headers_and_tokens(key):
    lines = "\n".join(textwrap.wrap(base64.b64encode(bytes(range(256)) * 2).decode(), 64))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{lines}\n-----END RSA PRIVATE KEY-----"
    assert ("pem", 2, 2 + len(pem)) in S.secret_spans("a " + pem)
    assert not [s for s in S.secret_spans(pem.replace("Proc-Type: 4,ENCRYPTED\n", "")) if s[0] == "pem"]
    b64 = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    odd = f'{b64("{" + chr(10) + chr(34) + "alg" + chr(34) + ":" + chr(34) + "HS256" + chr(34) + "}")}.{b64("{}")}.c2ln'
    assert odd.startswith("ewo") and ("token", 0, len(odd)) in S.secret_spans(odd)


def test_a_very_long_run_is_read_in_linear_time():
    assert S.secret_spans("MIIE" * 500_000) == [] and S.secret_spans("b3BlbnNzaC" * 100_000) == []


@pytest.mark.parametrize("text", [
    "x\n" + "A" * 10**6 + " word", "ab" * 10**6 + "\n", ("A" * 64 + "\n") * 15_000 + "-", "A" * 10**6 + "\n" + "A" * 10**6, "-----BEGIN " + "A" * 10**6,
    "-----BEGIN PRIVATE KEY-----\nA: " * 30_000, ("-----BEGIN PRIVATE KEY-----\n" + "A" * 40 + "\n") * 15_000, "token" + " " * 10**6, "ey" * 500_000 + ".", "password=" * 100_000,
    "\n" * 10**6 + "M", "AKIA" * 250_000, "a" * 10**6 + "\n", "eyJ." * 250_000,
])
def test_every_pattern_is_linear(text):
    began = time.perf_counter()
    S.secret_spans("x\n" + text)
    assert time.perf_counter() - began < 5


def test_wrapped_lines_after_a_run_without_a_break():
    key = base64.b64encode(rsa()).decode()
    wrapped = "\n".join(key[k : k + 64] for k in range(0, len(key), 64))
    text = "A" * 50 + " x\n" + wrapped + "\nend of it"
    assert ("key", text.index(wrapped[:60]), text.index("\nend")) in S.secret_spans(text)


def plain_spans(text):
    """The contract's patterns, word for word, and each substring of a base64 run that is a key up to the run's end."""
    out = [("assign", *m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    for m in re.finditer("[A-Za-z0-9+/_-]{40,}={0,2}", text):
        starts = [s for s in range(len(m.group())) if S.private_der(S.decode64(m.group()[s:]))]
        out += [("key", m.start() + starts[0], m.end())] if starts else []
    out += [("token", *m.span()) for m in re.finditer(r"(?<![\w.-])e[\w-]+\.[\w-]+\.[\w-]+", text, re.ASCII) if S.signed_token(m.group())]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def test_query_is_that_of_plain_patterns(spark, tmp_path, key):
    r = random.Random(1)
    bits = ["password: hunter22", "PASSWD='abc", "apikey = \"x-y_z=/.+1\"", "secret:tokenx123456", "AKIA" + "Z9" * 9, "AKIAAKIA12", "0123456789abcdef" * 2, "deadbeef", key, "k_" + key, token(), "token=" + token(), "ſecret=kelvin1", "api_\u212aey=abcdef1", "né", "\U0001f511", "plain", "MI" * 40, "\n"]
    rows = [(k, "".join(r.choice(bits) + r.choice(["", " ", "\n", "="]) for _ in range(r.randrange(0, 9)))) for k in range(300)]
    rows += [(500, None), (501, ""), (502, "word " * 200_000 + "token=abcdef"), (503, rows[5][1]), (503, rows[5][1]), (None, "secret=abcdefg")]
    spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, found string, spans int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_assign, x.n_access, x.n_hex, x.base_sha256, x.spans) for x in S.query(spark, str(tmp_path)).collect())
    want = []
    for i, t in rows:
        spans = plain_spans(t or "")
        base = [s for s in spans if s[0] in S.BASE_KINDS]
        join = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
        want.append((i is None, i or 0, *[sum(s[0] == k for s in base) for k in S.BASE_KINDS], hashlib.sha256(join(base).encode()).hexdigest(), join(spans)))
    assert got == sorted(want)
    assert S.query(spark, str(tmp_path)).limit(0).count() == 0
