"""Alignment of two tokenizers over a corpus, through white-space anchors.

A is a byte-level BPE file of the tokenizers library, which gets a space before the text; B is a sentencepiece model,
which puts one there itself.  Each text is tokenised whole by both.  A byte offset where tokens of both end is shared.

1. Anchors: shared ends before a token of A and a token of B that both start with a space.  They cut a text into windows,
   a word each as a rule.  Windows that are equal by their tuples of ids are aligned once: a memo of bounded size holds
   the groups and links of a window.  Both the cut and the memo rely on shared ends only, so windows are independent.
2. A text's links are counted by pair of ids, and the pairs of a block of texts (about 1 MB) share one list.  Only these
   lists are shuffled for the counts over the corpus: a pair that stands in every text is one row a block.
3. The counts come back to the blocks, each with the mark whether its count is the highest of its B id.

Links pair the tokens that end at one shared offset.  Defined results: null and empty texts, and texts that one of the
tokenizers does not give back byte by byte, have no tokens; special tokens in a text are plain text; repeated rows count
one by one; ids are not read, so they may be null or repeat; extra columns are not read; an empty table gives an empty
table.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPLIT, byte_alphabet, slices
from .common import materialise
from .fingerprints import _powers, mixed

BLOCK = 1_000_000
MEMO = 100_000
#: The fast splitter of A recurses through white space; longer stretches go through the library that the file is for.
LONG_SPACE = re.compile(r"\s{2000}")


def byte_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the tokens and whether they start with a space."""
    return np.array([len(t) for t in tokens], np.int64), np.array([t[:1] == b" " for t in tokens])


class Pair:
    """Both tokenizers; one per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        spec, letters = json.load(open(path_a, encoding="utf-8")), byte_alphabet()
        model = spec["model"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [ranks[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        self.path_a = path_a
        # Where ids are merge ranks the ids can be found faster than by the library.
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if all(
            x < y for x, y in zip(merged, merged[1:])) else None
        self.a = [b""] * (1 + max(max(ranks.values()), *[t["id"] for t in spec["added_tokens"]], 0))
        for b, i in ranks.items():
            self.a[i] = b
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        piece = lambda i: bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(
            i) else self.model.id_to_piece(i).replace("\u2581", " ").encode()
        self.b = [piece(i) for i in range(self.model.get_piece_size())]
        #: An id with the sign behind it, by twice the id plus one if it closes a group; A's ids first.
        self.names = [f"{i}{end}" for t, last in ((self.a, "|"), (self.b, ";")) for i in range(len(t)) for end in (",", last)]
        self.every_byte = all(bytes([x]) in ranks for x in range(256))
        self.random = mixed(np.arange(1, 1 + max(len(self.a), self.model.get_piece_size()), dtype=np.uint64))
        self.size_a, self.space_a = byte_table(self.a)
        self.size_b, self.space_b = byte_table(self.b)
        #: Groups as text and link codes of a window, by its ids.
        self.memo: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path_a)
        found.encode_special_tokens = True
        found.no_truncation()
        found.no_padding()
        return found

    def encode_a(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_SPACE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def tokens(self, text: str, ids_b: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None if one of them does not give the bytes back."""
        whole = " " + text
        data = whole.encode()
        if b"".join([self.b[i] for i in ids_b]) != data:
            return None
        ids_a = self.encode_a(whole)
        # With a token for every byte a byte-level encoding gives its text back; else it is looked at.
        if not self.every_byte and b"".join([self.a[i] for i in ids_a.tolist()]) != data:
            return None
        return ids_a.astype(np.int32), np.array(ids_b, np.int32)

    def align(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups of each document as text, link codes (A id, B id) of all documents, and the bounds between them."""
        if not docs:
            return [], np.zeros(0, np.int64), np.zeros(1, np.int64)
        a, b = [np.concatenate([d[i] for d in docs]) for i in (0, 1)]
        bounds_a = np.cumsum([0] + [len(d[0]) for d in docs])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # Documents give the same bytes on both sides, so a document's end is a shared end too.
        token_at = np.full(int(ends_a[-1]) + 1, -1, np.int32)
        token_at[ends_a] = np.arange(len(a), dtype=np.int32)
        at = token_at[ends_b]
        shared_b = np.flatnonzero(at >= 0)
        shared_a = at[shared_b].astype(np.int64)
        closes = np.zeros(len(a), bool)
        closes[bounds_a[1:] - 1] = True
        cut = closes[shared_a]
        inner = ~cut
        cut[inner] = self.space_a[a[shared_a[inner] + 1]] & self.space_b[b[shared_b[inner] + 1]]
        cuts = np.flatnonzero(cut)
        stop_a, stop_b = shared_a[cuts] + 1, shared_b[cuts] + 1
        start_a, start_b = np.concatenate([[0], stop_a[:-1]]), np.concatenate([[0], stop_b[:-1]])
        # Windows with equal ids are one: first by a fingerprint, then by their ids.
        print_of = ranges(self.random[a], start_a, stop_a) + mixed(ranges(self.random[b], start_b, stop_b) + np.uint64(1))
        _, first, which = np.unique(print_of, return_index=True, return_inverse=True)
        same = equal_ranges(a, start_a, stop_a, first[which]) & equal_ranges(b, start_b, stop_b, first[which])
        for i in np.flatnonzero(~same).tolist():
            which[i], first = len(first), np.append(first, i)
        raw_a, raw_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        groups_in = np.diff(np.concatenate([[0], cuts + 1]))  # shared ends of a window
        spelled, raw_codes = self.spelled(a, b, shared_a, shared_b), (a[shared_a].astype("<i8") << 32 | b[shared_b]).tobytes()
        name, known, memo, texts, codes = self.names.__getitem__, self.memo.get, self.memo, [], []
        bounds = [start_a[first], stop_a[first], start_b[first], stop_b[first], (cuts + 1 - groups_in)[first], (cuts + 1)[first]]
        for i, j, k, l, m, n in zip(*[x.tolist() for x in bounds]):
            key = raw_a[4 * i:4 * j], raw_b[4 * k:4 * l]
            found = known(key)
            if found is None:
                found = "".join(map(name, spelled[i + k:j + l]))[:-1], raw_codes[8 * m:8 * n]
                if len(memo) >= MEMO:
                    memo.clear()
                memo[key] = found
            texts.append(found[0])
            codes.append(found[1])
        flat = np.frombuffer(b"".join(codes), "<i8")
        size = groups_in[first]
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        n_links = size[which]
        links = flat[np.repeat(at[which], n_links) + np.arange(n_links.sum()) - np.repeat(np.cumsum(n_links) - n_links, n_links)]
        per_doc = np.searchsorted(stop_a, bounds_a[1:]) + 1
        edges = [0, *per_doc.tolist()]
        which = which.tolist()
        joined = [";".join([texts[i] for i in which[x:y]]) for x, y in zip(edges, edges[1:])]
        return joined, links, np.concatenate([[0], np.cumsum(n_links)])[np.array(edges)]

    def spelled(self, a: np.ndarray, b: np.ndarray, shared_a: np.ndarray, shared_b: np.ndarray) -> list[int]:
        """The alignment as a row of ``names``: the A ids of a group, its B ids, and the next group."""
        in_a, in_b = np.diff(shared_a, prepend=-1), np.diff(shared_b, prepend=-1)
        out, last_a, last_b = np.zeros(len(a) + len(b), np.int32), np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[shared_a] = last_b[shared_b] = True
        # A's ids stand behind the B ids of earlier groups, B's behind the A ids of their own group as well.
        out[np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)] = 2 * a + last_a
        out[np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b)] = 2 * (len(self.a) + b) + last_b
        return out.tolist()


def ranges(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A fingerprint of each range of values."""
    powers, inverse = _powers(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:len(values)])])
    return mixed((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))


def equal_ranges(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each range holds the ids of the range number ``other``; the ranges follow one another."""
    size = stop - start
    same = size == size[other]
    fits = np.repeat(same, size)
    place = np.arange(len(ids)) + np.repeat(start[other] - start, size)
    differs = ids != ids[np.where(fits, place, 0)]
    return same & ~np.logical_or.reduceat(differs, start)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


#: One row per block.  By document: doc_id to groups_sha256, size (distinct pairs), and on request the groups; by
#: document and pair: which (place in codes) and times; by pair: codes and totals.
BLOCKS = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, groups array<string>, size array<int>, which array<int>, times array<int>, "
          "codes array<long>, totals array<long>")


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    kinds = [pa.int64(), *[pa.list_(t) for t in (*[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int32()] * 3, pa.int64(), pa.int64())]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, block = pair_of(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, BLOCK):
                texts = [t or "" for t in part.column(1).to_pylist()]
                coded = [pair.tokens(t, b) if t else None for t, b in zip(texts, pair.model.encode(texts, num_threads=1))]
                joined, links, edges = pair.align([c for c in coded if c])
                listed, every = np.unique(links, return_inverse=True)
                rows, which, times, i = [], [], [], 0
                for found in coded:
                    if found is None:
                        rows.append((0, 0, 0, 0, "", "" if with_groups else None, 0))
                        continue
                    distinct, n = np.unique(every[edges[i]:edges[i + 1]], return_counts=True)
                    which.append(distinct)
                    times.append(n)
                    # An offset is shared by one token of each side, so groups and links are as many.
                    n_links = int(edges[i + 1] - edges[i])
                    rows.append((len(found[0]), len(found[1]), n_links, n_links, hashlib.sha256(joined[i].encode()).hexdigest(),
                                 joined[i] if with_groups else None, len(distinct)))
                    i += 1
                which, times = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, times)]
                totals = np.bincount(every, minlength=len(listed)).astype(np.int64)
                values = [block, part.column(0).to_pylist(), *map(list, zip(*rows)), which.astype(np.int32), times.astype(np.int32),
                          listed.astype(np.int64), totals]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)
                block += 1

    return docs.mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, links, best): links of each pair over the corpus, and whether no pair of its B id has more.

    The code is the A id times 2^32 plus the B id."""
    counts = blocks.select(F.explode(F.arrays_zip("codes", "totals")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(
        F.sum("p.totals").alias("links")).withColumn("b", F.col("code").bitwiseAND(0xFFFFFFFF))
    counts = materialise(counts)
    highest = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(highest, "b").select("code", "links", (F.col("links") == F.col("most")).alias("best"))


def token_map(blocks: DataFrame) -> DataFrame:
    """(a_id, b_id, links, best): the tokens of A that end with each token of B, and how often."""
    return pair_counts(blocks).select(F.shiftright("code", 32).alias("a_id"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("b_id"), "links", "best")


def align_documents(docs: DataFrame, path_a: str, path_b: str, doc_id="doc_id", text="text", with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, on request, the
    groups themselves (``a1,a2|b1;a3|b2,b3``, else null)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = materialise(aligned_blocks(docs, path_a, path_b, with_groups))
    pairs = blocks.select("block", F.posexplode("codes").alias("place", "code"))
    answers = pairs.join(materialise(pair_counts(blocks)), "code").groupBy("block").agg(  # as many as the block has pairs
        F.sort_array(F.collect_list(F.struct("place", "links", "best"))).alias("pairs")).select(
        "block", F.col("pairs.links").alias("links"), F.col("pairs.best").alias("best"))
    met = blocks.drop("codes", "totals").join(answers, "block", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "size", "which", "times", "links", "best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].values for c in range(10)]
                which, times = row[8].to_numpy(), row[9].to_numpy().astype(np.int64)
                n, size = len(row[0]), row[7].to_numpy()
                sums = [np.zeros(n, np.int64)] * 2
                if len(which):
                    doc = np.repeat(np.arange(n), size)
                    links, best = [batch.column(c)[i].values.to_numpy(zero_copy_only=False)[which] for c in (10, 11)]
                    sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
                    np.add.at(sums[0], doc, times * best)
                    np.add.at(sums[1], doc, times * links)
                yield pa.RecordBatch.from_arrays([*row[:5], pa.array(sums[0]), pa.array(sums[1]), row[5], row[6]], names=names)

    out = met.select(*order).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                             "count_sum long, groups_sha256 string, groups string")
    return out
