"""Token ids of whole texts, by the tokenizers library with a memory of words.

The tokenizers meant here drop white space between words and encode each word alone, so
a text's ids are those of its words in order. Each task therefore encodes a distinct
word once and lays the ids of a slice of texts out with numpy. ``encode_ids`` checks
from the tokenizer's file that this holds and otherwise encodes whole texts.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retort.llm.words import slices, split_words

#: Words that a worker remembers at most; the older half goes when there are more.
REMEMBERED = 400_000

# Letters that lower-casing and canonical composition leave as they are, and marks that may follow them.
_PLAIN_LETTERS = "".join(map(chr, (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))))
_LETTERS = "^[a-zß-öø-ÿ]+$"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Writers of so many ids.
_PACKERS = [struct.Struct(f"<{n}I") for n in range(32)]


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers' files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets show printable bytes as themselves and the others as letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Encodes Arrow text columns with one tokenizer file."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = [s["type"] for s in (kind.get("normalizer") or {}).get("normalizers", [])]
        parts = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])
        by_word = bool(parts) and parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", "")
        bare = all(not (t["lstrip"] or t["rstrip"]) and not re.search(r"\s", t["content"]) for t in kind.get("added_tokens", []))
        self.by_word = by_word and bare and kind["model"].get("dropout") is None
        #: Plain lower-case words and marks go to the model straight away.
        self.straight = self.by_word and steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        self.specials = [t["content"] for t in kind.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _slow(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _model(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(word)]
        return _PACKERS[len(ids)].pack(*ids) if len(ids) < len(_PACKERS) else np.array(ids, "<u4").tobytes()

    def _known(self, words: list[str], encode: Callable[[str], bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers, from memory or by ``encode``."""
        found = list(map(self.new.get, words))
        for k, ids in enumerate(found):
            if ids is None:
                word = words[k]
                ids = self.old.get(word)
                if ids is None:
                    ids = encode(word)
                if len(self.new) > REMEMBERED // 2:
                    self.old, self.new = self.new, {}
                self.new[word] = found[k] = ids
        return found

    def _straight(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids) of words: plain ones as letters, then marks, each part encoded once; others whole."""
        letters = pc.utf8_rtrim(distinct, _MARKS)
        size = pc.binary_length(letters)
        plain = pc.match_substring_regex(letters, _LETTERS)
        marked = pc.greater(pc.binary_length(distinct), size)
        for special in self.specials:
            plain = pc.and_(plain, pc.invert(pc.match_substring(distinct, special)))
        plain = plain.to_numpy(zero_copy_only=False)
        marked = marked.to_numpy(zero_copy_only=False) & plain
        stems = letters.dictionary_encode()
        stem_of = stems.indices.to_numpy()
        used = np.unique(stem_of[plain])
        parts = self._known(stems.dictionary.take(pa.array(used)).to_pylist(), self._model)
        tails, ends = np.zeros(0, np.int64), pa.array([], pa.string())
        if marked.any():
            some = pa.array(marked)
            coded = pc.utf8_ltrim(distinct.filter(some), _PLAIN_LETTERS).dictionary_encode()
            tails, ends = coded.indices.to_numpy(), coded.dictionary
        first_end = len(parts)
        parts = parts + self._known(ends.to_pylist(), self._model)
        first_whole = len(parts)
        parts = parts + self._known(distinct.filter(pa.array(~plain)).to_pylist(), self._slow)
        # Every word is one or two of the parts.
        one = np.zeros(len(distinct), np.int64)
        one[plain] = np.searchsorted(used, stem_of[plain])
        one[~plain] = first_whole + np.arange(len(parts) - first_whole)
        two = np.full(len(distinct), -1, np.int64)
        two[marked] = first_end + tails
        order = np.stack([one, two], 1).ravel()
        order = order[order >= 0]
        bounds, ids = _laid_out(parts, order)
        n_parts = 1 + (two >= 0)
        return bounds[np.r_[0, np.cumsum(n_parts)]], ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): the ids of text i are ``ids[bounds[i]:bounds[i + 1]]``; a null text has none."""
        if not self.by_word:
            each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.r_[0, np.cumsum([len(e) for e in each])].astype(np.int64), np.concatenate([np.zeros(0, np.uint32), *each])
        fold = self.straight and not any(pc.any(pc.match_substring(texts, s[:2])).as_py() for s in self.specials)
        words = split_words(texts, lower=fold)
        if self.straight:
            bounds, store = self._straight(words.distinct)
        else:
            bounds, store = _laid_out(self._known(words.distinct.to_pylist(), self._slow), np.arange(len(words.distinct)))
        begins, ids = _gathered(bounds, store, words.codes)
        return begins[words.bounds], ids


def _gathered(bounds: np.ndarray, store: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``store`` one after the other in the given order, and where each begins."""
    n = np.diff(bounds)[order] if len(order) else np.zeros(0, np.int64)
    ends = np.r_[0, np.cumsum(n)]
    if not ends[-1]:
        return ends, np.zeros(0, np.uint32)
    at = np.repeat(bounds[:-1][order] - ends[:-1], n) + np.arange(ends[-1])
    return ends, store[at]


def _laid_out(parts: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_gathered` of parts given as bytes."""
    length = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return _gathered(np.r_[0, np.cumsum(length)], np.frombuffer(b"".join(parts), "<u4"), order)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; its memory of words lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(bounds: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    return bounds + np.arange(len(bounds)), np.insert(ids, bounds[1:], np.uint32(end_id))


def id_type(tokenizer_path: str) -> str:
    """The numpy type that holds every id of a tokenizer: 16 bits where the vocabulary fits, else 32."""
    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str = "<u4", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each row's ids with ``end_id`` behind them, as the bytes of unsigned integers of type ``kind``."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bounds, ids = with_end(*encoder(tokenizer_path).encode(part.column("text")), end_id)
                offsets, data = pa.array((bounds * width).astype(np.int32)), pa.py_buffer(ids.astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.Array.from_buffers(pa.binary(), len(part), [None, offsets.buffers()[1], data])], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")
