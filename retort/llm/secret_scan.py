"""Secret scans: patterns, and candidates that are confirmed by their structure.

Three patterns give the base spans. The method adds spans of base64 and hex candidates
whose decoded bytes are a key: a private key in DER, where every nested length must fit
exactly, an OpenSSH private key with its length-prefixed fields, or a PEM block around
either; and of signed tokens, whose header must decode to JSON that names an algorithm
and whose payload must decode too. A key may be wrapped into lines of one width, or be
glued to a prefix of letters that base64 has too. A candidate that does not parse is not
reported.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "token", "key", "hexkey")

# The base patterns; the smallest lengths are tested in base_spans.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MARKS = ("passw", "secret", "token", "api")

# A match starts at the start of a run and gives nothing back that it need not, so each pattern reads a text in linear time.
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,8}PRIVATE KEY)-----((?:\s*+[A-Za-z][A-Za-z0-9-]*+: (?:(?!-----BEGIN )[^\n])*+\n)*+)([A-Za-z0-9+/=\s\\]*+)-----END \1-----")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[wy][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}+[ \t\r]*+\n[ \t]*+)+[A-Za-z0-9+/_-]++={0,2}")
_STARTS = re.compile(r"(?=M[A-P]|b3BlbnNzaC)")
_HEXES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")

_OPENSSH = b"openssh-key-v1\0"
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, in code points, ends exclusive."""
    found: list[Span] = []
    low = text.lower()
    if any(m in low for m in _MARKS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def der_item(data: bytes, begin: int, end: int) -> tuple[int, int, int]:
    """(tag, begin, end) of the DER value at ``begin``; ValueError if there is none that ends by ``end``."""
    if begin + 2 > end or data[begin] & 0x1F == 0x1F:
        raise ValueError("no tag")
    tag, n, at = data[begin], data[begin + 1], begin + 2
    if n >= 0x80:
        wide = n & 0x7F
        if not 1 <= wide <= 4 or at + wide > end or data[at] == 0:
            raise ValueError("no length")
        n, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if n < 0x80:
            raise ValueError("length not minimal")
    if at + n > end:
        raise ValueError("length beyond the end")
    return tag, at, at + n


def der_items(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]]:
    """(tag, begin, end) of the DER values that fill data[begin:end] exactly; ValueError if they don't."""
    out = []
    while begin < end:
        out.append(der_item(data, begin, end))
        begin = out[-1][2]
    return out


def private_der(data: bytes, begin: int = 0) -> bool:
    """Whether the bytes from ``begin`` on are one RSA, EC, DSA or wrapped private key with all nested lengths right."""
    try:
        tag, at, end = der_item(data, begin, len(data))
        if tag != 0x30 or end != len(data):
            return False
        parts = der_items(data, at, end)
        tags = [t for t, _, _ in parts]
        inner = lambda k: [t for t, _, _ in der_items(data, *parts[k][1:])]
        if tags[:1] == [0x02] and len(tags) in (6, 9) and set(tags) == {0x02}:  # DSA or RSA numbers
            return parts[0][2] - parts[0][1] == 1
        if tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1}:  # EC
            return data[parts[0][1] : parts[0][2]] == b"\x01" and parts[1][2] - parts[1][1] >= 16 and all(len(inner(k)) == 1 for k in range(2, len(parts)))
        if tags[:3] == [0x02, 0x30, 0x04] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:  # PKCS 8
            return inner(1)[:1] == [0x06] and parts[2][2] - parts[2][1] >= 16
        return tags == [0x30, 0x04] and inner(0)[:1] == [0x06] and parts[1][2] - parts[1][1] >= 16  # encrypted PKCS 8
    except (ValueError, IndexError):
        return False


def private_ssh(data: bytes, begin: int = 0) -> bool:
    """Whether the bytes from ``begin`` on are an OpenSSH private key: marker, three strings, a count, then public and private parts."""
    if not data.startswith(_OPENSSH, begin):
        return False
    at, fields = begin + len(_OPENSSH), 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if fields == 3:  # the number of keys
            if n < 1:
                return False
            at, fields = at + 4, fields + 1
            continue
        at, fields = at + 4 + n, fields + 1
        if at > len(data):
            return False
    return at == len(data) and fields >= 6


def decode64(text: str) -> bytes:
    """Standard or URL-safe base64, padded or not; empty if it is neither."""
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return b""
    try:
        return base64.b64decode(text.translate({45: 43, 95: 47}) + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def signed_token(text: str) -> bool:
    """Whether header and payload decode and the header names an algorithm; a signature may be missing only for none."""
    head, body, sign = text.split(".")[:3]
    try:
        header = json.loads(decode64(head))
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        if "enc" in header:
            return True
        return isinstance(json.loads(decode64(body)), dict) and (bool(decode64(sign)) or header["alg"].lower() == "none")
    except (ValueError, RecursionError):
        return False


def key_start(run: str) -> int:
    """Where in a base64 run a private key begins that ends with the run; -1 if none does.

    The run is decoded once for each of the four phases, and every start that can begin a
    key is parsed in place: its outer length alone rules nearly all of them out.
    """
    run = run.rstrip("=")
    decoded: dict[int, bytes] = {}
    for m in _STARTS.finditer(run):
        s, phase = m.start(), m.start() % 4
        if phase not in decoded:
            decoded[phase] = decode64(run[phase:])
        data, at = decoded[phase], (s - phase) // 4 * 3
        if data and (private_der(data, at) or private_ssh(data, at)):
            return s
    return -1


def _wrapped(m: re.Match) -> Iterator[tuple[int, int, str]]:
    """(begin, end, joined) of runs of lines of one width, each with the shorter line that ends it."""
    held: list[re.Match] = []
    for line in [*re.finditer(r"\S+", m[0]), None]:
        width = len(held[0][0]) if held else 0
        if held and (line is None or len(line[0]) > width or len(held[-1][0]) < width):
            if len(held) > 1:
                yield m.start() + held[0].start(), m.start() + held[-1].end(), "".join(x[0] for x in held)
            held = []
        if line is not None:
            held.append(line)


def _pem_key(head: str, body: str) -> bool:
    """Whether a PEM block holds a key, or, under headers that say so, whole cipher blocks of one."""
    data = decode64(re.sub(r"\\[nr]|\s", "", body))
    if re.search(r"^\s*Proc-Type: 4,ENCRYPTED\s*$", head, re.MULTILINE) and "DEK-Info: " in head:
        return len(data) >= 64 and len(data) % 8 == 0
    return private_der(data) or private_ssh(data)


def confirmed_spans(text: str) -> list[Span]:
    """Spans whose decoded structure shows a key or a signed token."""
    found: list[Span] = []
    if "-----BEGIN " in text:
        found += [("pem", *m.span()) for m in _PEM.finditer(text) if _pem_key(m[2], m[3])]
    if "." in text and ("ey" in text or "ew" in text):
        found += [("token", *m.span()) for m in _TOKEN.finditer(text) if signed_token(m[0])]
    pems = [(a, b) for k, a, b in found if k == "pem"]
    inside = lambda a, b: any(x <= a and b <= y for x, y in pems)
    runs = list(_BASE64.finditer(text))
    for m in runs:
        s = key_start(m[0])
        if s >= 0 and not inside(*m.span()):
            found.append(("key", m.start() + s, m.end()))
    for m in _WRAPPED.finditer(text) if len(runs) and "\n" in text else ():
        for a, b, joined in _wrapped(m):
            s = key_start(joined)
            if s == 0 and not inside(a, b):
                found.append(("key", a, b))
    for m in _HEXES.finditer(text):
        data = bytes.fromhex(m[0])
        if private_der(data) or private_ssh(data):
            found.append(("hexkey", *m.span()))
    return found


def secret_spans(text: str | None) -> list[Span]:
    """All spans by start, then kind as listed in KINDS, then end."""
    if not text:
        return []
    return sorted({*base_spans(text), *confirmed_spans(text)}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by the marker of its first span's kind."""
    spans, out, at = secret_spans(text), [], 0
    runs: list[list] = []
    for kind, a, b in spans:
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([kind, a, b])
    for kind, a, b in runs:
        out += [text[at:a], f"[{kind} removed]"]
        at = b
    return "".join(out) + text[at:] if runs else text


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def _find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t)] for t in s], index=s.index, dtype=object)


@F.pandas_udf(T.StringType())
def _redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([redacted(t) for t in s], index=s.index, dtype=object)


def find_secrets(text: Column | str) -> Column:
    """Column of all spans of a text: array of (kind, start, end) by start; a null or empty text has none.

    A text is scanned whole, however long, and alone, so that repeated rows give equal
    spans and an empty table gives an empty result; no other column is read.
    """
    return _find(text)


def redact_secrets(text: Column | str) -> Column:
    """Column of the text without its secrets; null stays null."""
    return _redact(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``: base counts, the digest of the base spans, and all spans."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", find_secrets("text").alias("found"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("found", lambda s: s.kind.isin(*BASE_KINDS))
    counts = [F.expr(f"bigint(size(filter(found, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def span_digest(spans: list[Span]) -> str:
    """The digest that the query gives for these spans."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
