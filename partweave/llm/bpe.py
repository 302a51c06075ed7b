"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token the encoding has exactly one last token.  An automaton over the vocabulary lists the
tokens that end at each position; the last token of a prefix is the one that is compatible with the last token of the
prefix before it, i.e. whose pair encodes to just that pair.  Back-pointers then give the ids.  Compatibility looks at
the merge trees along the seam: a merge of rank r across it would fire if r comes before the merges that consume the
two tokens beside the seam.

Defined results: null text is the empty text and has no ids; text is encoded as the library does it without special
tokens added, so the text of an added token found in a document becomes that token; the vocabulary file is a
parameter; repeated rows are encoded one by one; extra columns are kept by ``encode_documents``.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The split of the byte-level pre-tokenizer; white space is the Unicode property.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same split for texts up to U+02C1, where these classes are what the properties above contain.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ˁ", "0-9²³¹¼½¾", r" \t\n\r\x0b\x0c\x85\xa0"
LATIN_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
BEYOND_LATIN = r"[^\x00-ˁ]"

CACHE = 500_000
PAIRS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in the vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """One per Python worker; holds the vocabulary, the automaton and two bounded caches."""

    def __init__(self, path: str):
        import ahocorasick

        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: c.encode() for c, i in self.added.items()}
        vocabulary = {t: i for t, i in model["vocab"].items() if i not in self.bytes_of}
        for t, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in t)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right = vocabulary[a], vocabulary[b]
            self.rank[left, right] = r
            self.parts.setdefault(vocabulary[a + b], (left, right, r))
        self.automaton = ahocorasick.Automaton()
        for t, i in vocabulary.items():
            word = self.bytes_of[i].decode("latin-1")
            self.automaton.add_word(word, i)
        self.automaton.make_automaton()
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        self.split, self.latin_split = regex.compile(SPLIT), re.compile(LATIN_SPLIT)
        self.beyond_latin = re.compile(BEYOND_LATIN)
        self.special = regex.compile("|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at the seam from the whole token down to its outermost byte, each with the rank that consumes it."""
        found = self.spines.get((token, side))
        if found is None:
            found, at, consumed = [], token, float("inf")
            while True:
                found.append((at, consumed))
                if at not in self.parts:
                    break
                consumed = self.parts[at][2]
                at = self.parts[at][side]
            self.spines[token, side] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge fires across the seam of the pair; answers are kept in a bounded cache."""
        rank, inner = self.rank, self._spine(right, 0)
        known = True
        for x, x_end in self._spine(left, 1):
            for y, y_end in inner:
                r = rank.get((x, y))
                # Equal ranks: the merge further left fires first.
                if r is not None and r < x_end and r <= y_end:
                    known = False
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[left, right] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        size, fits, compatible = self.size, self.fits, self.compatible
        for end, token in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - size[token]
                if start:
                    before = last[start]
                    known = fits.get((before, token))
                    if known is None:
                        known = compatible(before, token)
                    if not known:
                        continue
                last[end], back[end] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return ids

    def _plain(self, text: str) -> list[bytes]:
        words, out = self.words, []
        split = self.split if self.beyond_latin.search(text) else self.latin_split
        for w in split.findall(text):
            ids = words.get(w)
            if ids is None:
                ids = np.array(self.encode_word(w.encode()), "<u4").tobytes()
                if len(words) >= CACHE:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is None or not any(c in text for c in self.added):
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(np.array([self.added[m[0]]], "<u4").tobytes())
            at = m.end()
        return b"".join(out + self._plain(text[at:]))

    def decode(self, ids: bytes) -> str:
        known = self.bytes_of
        return b"".join([known[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, text="text", ids="ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and, on request, the text decoded from them; a column that
    has one of these names already is replaced.

    Narrow: no shuffle; a worker holds one Arrow batch, its vocabulary and two bounded caches."""
    docs = docs.drop(*[c for c in (ids, decoded) if c])
    at = docs.columns.index(text)
    extra = [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in slices(batch, at):
                coded = [bpe.encode(t) if t else b"" for t in part.column(at).to_pylist()]
                columns = [*part.columns, pa.array(coded, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(c) for c in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*docs.schema.fields, *extra])
    names = schema.fieldNames()
    return docs.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, at: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``most`` bytes of text, one row at least."""
    column = batch.column(at)
    sizes = np.cumsum(np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def decode_documents(coded: DataFrame, path: str, ids="ids", text="decoded") -> DataFrame:
    """Add the text that a column of ids stands for; null ids give null."""
    at = coded.columns.index(ids)
    schema = T.StructType([*coded.schema.fields, T.StructField(text, T.StringType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [None if c is None else bpe.decode(c) for c in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return coded.mapInArrow(run, schema)
