"""BPE encoding and decoding with a public tokenizer file."""

from __future__ import annotations

import heapq
import json
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from flowtriage.llm.common import Plain, bound_batches

#: White space of the tokenizer's pattern language. Python's own split() adds the separators \x1c-\x1f.
SPACE_RUN = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD_SEPARATOR = regex.compile("[\x1c-\x1f]")
CACHED_CHARS, CACHED_WORDS = 48, 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class WordBpe:
    """A byte-level BPE tokenizer file with word ends, read from its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("not a byte-level BPE file with word ends")
        vocab = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + "</w>"] for s in symbols]
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the merge of least rank first, the leftmost of equals.

        Symbols are a doubly linked list by position. A queue entry is stale if its left symbol is gone or the pair
        at that place has another rank by now; it is skipped.
        """
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(found[0], i) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            if ids[i] < 0 or (j := after[i]) < 0:
                continue
            found = merges.get((ids[i], ids[j]))
            if found is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((ids[i], ids[k])):
                    heapq.heappush(queue, (found[0], i))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], ids[i]))):
                heapq.heappush(queue, (found[0], h))
        return [i for i in ids if i >= 0]

    def chunk(self, text: str) -> bytes:
        """Packed ids of lower-cased text without white space."""
        found = self.cache.get(text)
        if found is None:
            ids = [i for word in self.words.findall(text) for i in self.merge(word)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(text) <= CACHED_CHARS:
                if len(self.cache) >= CACHED_WORDS:
                    self.cache.clear()
                self.cache[text] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # Each character is lower-cased on its own, so a final sigma is an ordinary one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        chunks = SPACE_RUN.split(text) if ODD_SEPARATOR.search(text) else text.split()
        get, make = self.cache.get, self.chunk
        return b"".join([get(c) or make(c) for c in chunks])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(token in text for token in self.special):
            return self._plain(text)
        parts = self.specials.split(text)
        return b"".join(struct.pack("<I", self.special[p]) if i % 2 else self._plain(p) for i, p in enumerate(parts))


def vocabulary(text: str) -> list[str]:
    """The string of each id of a tokenizer file."""
    spec = json.loads(text)
    named = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = [""] * (max(named.values()) + 1)
    for token, i in named.items():
        strings[i] = token
    return strings


def decoded_text(ids: bytes, strings: list[str]) -> str:
    """Vocabulary strings of the ids, with one space between, as the file has no decoder."""
    return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _with_ids(docs: DataFrame, plain: Plain, text: str, path: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_tokenizer_text(path))  # one file of a fixed size

    @F.pandas_udf("binary")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = WordBpe(shared.value)
        for batch in texts:
            yield pd.Series([b"" if t is None else tokenizer.encode(t) for t in batch], dtype=object)

    return plain.df.withColumn("_ids", encoded(F.col(text)))


def _decoded(docs: DataFrame, path: str):
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(_tokenizer_text(path)))

    @F.pandas_udf("string")
    def decoded(packed: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in packed:
            yield pd.Series([decoded_text(b, shared.value) for b in batch], dtype=object)

    return decoded


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All rows with `ids_col`, the ids of the whole text as little-endian unsigned 32-bit integers.

    The driver reads the tokenizer file once and sends its text along. Each task keeps the ids of words it has met, up
    to a fixed number. A null text counts as empty and has no ids; strings of special tokens in a text become those
    tokens. Repeated rows get equal ids, an empty table an empty result; a column named like the result is replaced.
    """
    plain = Plain(bound_batches(docs))
    return plain.restore(_with_ids(docs, plain, plain[text_col], path), **{ids_col: F.col("_ids")})


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All rows with `text_col`, the decoded ids; null ids count as none."""
    plain = Plain(bound_batches(rows))
    ids = F.coalesce(F.col(plain[ids_col]), F.lit(b""))
    return plain.restore(plain.df, **{text_col: _decoded(rows, path)(ids)})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
