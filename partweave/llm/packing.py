"""Packing of documents into sequences of fixed length: shortest-pack-first over the length histogram.

Each document is tokenised, ended with one id and cut every ``capacity`` ids; what is placed are these pieces.  Only
the histogram of piece lengths (``capacity`` rows at most, whatever the corpus) reaches the driver.  Lengths are
placed longest first into the open packing pattern with the most room, i.e. the shortest pack; patterns carry counts,
which split when a length runs out.  Patterns become slots, and pieces meet slots by their rank within their length.

Defined results: null text is empty and consists of the end id alone; ids must be unique; extra columns are not read;
an empty table gives no pieces; equal lengths are ranked by salt, id and start, so any order of the input rows gives
the same placement.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import _L, _N, _S, byte_alphabet, slices
from .common import materialise

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: The split rule of the tokenizer for texts up to U+02C1 without the one letter whose lower case lies beyond.  Letters
#: are tried first, as most words are made of them; a word that begins with an apostrophe matches no other branch before its own.
LATIN_WORDS = rf"[{_L}]+|[{_N}]|'(?:[stmd]|re|ve|ll)|[^{_S}{_L}{_N}]+"
NOT_LATIN = "[^\x00-\u012f\u0131-\u02c1]"
CACHE = 400_000
RANK_GROUP = 20_000


class WordTokenizer:
    """The library's tokenizer behind a bounded cache.

    Texts up to U+02C1 are unchanged by its normal form and split by ``LATIN_WORDS`` as by its own rule, so only new
    words go to its model.  Other texts, and those with the text of an added token, are cut at blanks and line feeds
    (which never become part of a token and no rule looks across) and go through the whole tokenizer."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.words, self.other = re.compile(LATIN_WORDS), re.compile(NOT_LATIN)
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        if self.other.search(text) or any(a in text for a in self.added):
            return self._whole(text)
        known, out = self.known, []
        for w in self.words.findall(text.lower()):
            ids = known.get(w)
            if ids is None:
                tokens = self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))
                ids = np.array([t.id for t in tokens], "<u4").tobytes()
                if len(known) >= CACHE:
                    known.clear()
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def _whole(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        new = list({w for w in words if w not in self.chunks})
        if len(self.chunks) + len(new) > CACHE // 4:
            self.chunks = {"": b""}
            new = list({w for w in words if w})
        for e, w in zip(self.tokenizer.encode_batch_fast(new, add_special_tokens=False), new):
            self.chunks[w] = np.array(e.ids, "<u4").tobytes()
        return b"".join([self.chunks[w] for w in words])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut_pieces(docs: DataFrame, path: str, capacity=2048, end_id=1, doc_id="doc_id", text="text",
               with_ids=False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; ``with_ids`` adds the ids themselves (binary)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                rows = []
                for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = tokenizer.encode(t or "") + end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        piece = ids[4 * at:4 * (at + capacity)]
                        rows.append((key, at, len(piece) // 4, zlib.crc32(piece), n, *([piece] if with_ids else [])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(zip(*rows))], names=names)

    names = [c.split()[0] for c in PIECES.split(", ")] + (["ids"] if with_ids else [])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, PIECES + (", ids binary" if with_ids else ""))


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of every packing pattern."""
    open_by_room: dict[int, list[tuple[int, list[int]]]] = {}
    closed: list[tuple[int, list[int]]] = []

    def put(count: int, lengths: list[int], room: int) -> None:
        if room:
            open_by_room.setdefault(room, []).append((count, lengths))
        else:
            closed.append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_by_room, default=0)
            if room < length:
                fits = capacity // length
                whole, rest = divmod(left, fits)
                if whole:
                    put(whole, [length] * fits, capacity - length * fits)
                if rest:
                    put(1, [length] * rest, capacity - length * rest)
                break
            count, lengths = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
            taken = min(left, count)
            put(taken, [*lengths, length], room - length)
            if count > taken:
                put(count - taken, lengths, room)
            left -= taken
    return closed + [p for patterns in open_by_room.values() for p in patterns]


def pattern_slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): one row per position of a pattern."""
    slots, ranks, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            slots.append((length, first, first + count, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return slots


def ranked(pieces: DataFrame, histogram: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0 without gathering a length in one task.

    A length with many pieces is dealt over salts of about ``RANK_GROUP`` pieces; ranks run within a salt and start
    from the number of pieces in the salts before."""
    salted = pieces.join(F.broadcast(histogram), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start"), F.ceil(F.col("n") / RANK_GROUP)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("in_salt")).withColumn(
        "before", F.sum("in_salt").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
    local = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1
    return salted.withColumn("local", local).join(counts, ["length", "salt"]).withColumn(
        "rank", F.col("local") + F.coalesce("before", F.lit(0))).drop("local", "before", "in_salt", "salt", "n")


def pack_documents(docs: DataFrame, path: str, capacity=2048, end_id=1, doc_id="doc_id", text="text") -> DataFrame:
    """One row per piece with its place: sequence_id and offset."""
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, path, capacity, end_id, doc_id, text))
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}  # at most ``capacity`` rows
    slots = pattern_slots(pack_histogram(counts, capacity))
    slot_rows = spark.createDataFrame(
        slots, "length long, first_rank long, end_rank long, first_sequence long, slot_offset long")
    known = spark.createDataFrame(list(counts.items()), "length long, n long")
    return (
        ranked(pieces, known).alias("p").join(F.broadcast(slot_rows).alias("s"), "length")
        .filter((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
                F.col("slot_offset").alias("offset"))
    )
