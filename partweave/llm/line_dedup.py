"""Line dedup with two Bloom filters: only lines that look repeated are shuffled.

A line's key is the line without white space at its ends, A-Z in lower case.  A key of ``least`` code points or more
that two documents hold loses its lines everywhere but in the document of smallest id.

1. Each task hashes the keys of its documents and sends, for each slice of the filter, the bits that its keys set once
   and the bits that its repeated keys set twice: two bytes a bit, no text.  Slices merge by ``once = a | b`` and
   ``twice = a2 | b2 | (a & b)``, so a bit is in the second filter if two documents set it, whoever held them.
2. The second filter goes to every task.  Its size follows the number of keys up to ``most_bits`` (a parameter, 32 MB)
   and no further: a fuller filter lets more keys through and never loses one, so the result does not depend on it.
3. A second scan emits the keys that pass, one row per key and task with all places of the key in it, so that a line
   which a third of all documents hold is one row per task.  These suspects are grouped by the whole key: a key with two
   ids is a repeat, its least id keeps its lines.
4. Documents with a suspected line meet the lines to drop by id.  The other documents are passed on where they are.

Defined results: null and empty texts are one empty line and stay as they are; short keys and blank lines stay; a key
repeated inside one document only stays; ids must be unique, a row without an id keeps all lines and makes no other
line a repeat; extra columns are kept by ``without_repeated_lines``; an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .fingerprints import Prefixes, byte_chunks, mixed
from .suffix_dedup import _unpacked

#: Bits of one slice of a filter, and bits that a key sets.
SLICE, MARKS = 1 << 16, 3
CHUNK, KEYS = 1 << 21, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Lines:
    """Lines of the texts that ``offsets`` cut out of ``data``: the row, number and key of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        # A line ends at each line break and at the end of each text.
        ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
        row = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(n)])[
            np.argsort(np.concatenate([breaks, offsets[1:]]), kind="stable")]
        self.row, self.count = row, np.bincount(row, minlength=n)
        first = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1] + 1])[:len(ends)]
        starts[first] = offsets[:-1]
        self.number = np.arange(len(row)) - first[row]
        # Key: from the first to the last byte that is not white space.
        solid = np.flatnonzero(~_SPACE[data])
        lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        full = hi > lo
        self.start, self.end = starts.copy(), starts.copy()
        self.start[full], self.end[full] = solid[lo[full]], solid[hi[full] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.points = points[self.end] - points[self.start]
        self.data = _LOWER[data]

    def hashes(self, at: np.ndarray) -> np.ndarray:
        start, end = self.start[at], self.end[at]
        return mixed(Prefixes(self.data).of(start, end) + (end - start).astype(np.uint64))


def marks(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, all in one slice: MARKS rows."""
    piece = (hashes >> np.uint64(48)) % np.uint64(max(1, bits // SLICE)) * np.uint64(SLICE)
    return np.stack([piece + ((hashes >> np.uint64(16 * i)) & np.uint64(SLICE - 1)) for i in range(MARKS)]).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], least: int):
    """(ids, lines, long lines with an id, texts) of about ``CHUNK`` bytes of text at a time: numbers of eight bytes for
    each of them, so a chunk costs some hundred megabytes when it is 2 MB."""
    for batch in batches:
        for begin, end, data, offsets in byte_chunks(batch.column(1).fill_null(""), CHUNK):
            lines = Lines(data, offsets)
            ids = batch.column(0).slice(begin, end - begin)
            known = np.array(ids.is_valid())
            at = np.flatnonzero((lines.points >= least) & known[lines.row])
            yield ids, lines, at, batch.column(1).slice(begin, end - begin)


def key_bits(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """(slice, once, twice): 16-bit places that the keys of a task set, about ``KEYS`` keys at a time."""

    def sent(found: list[np.ndarray]) -> pa.RecordBatch:
        keys, docs_of = np.unique(np.concatenate(found), return_counts=True)
        once = np.unique(marks(keys, bits))
        twice = np.unique(marks(keys[docs_of > 1], bits))
        pieces = np.unique(once // SLICE)
        cut = lambda x: [b.tobytes() for b in np.split((x % SLICE).astype("<u2"), np.searchsorted(x, pieces[1:] * SLICE))]
        return pa.RecordBatch.from_arrays([pa.array(pieces.astype(np.int32)), pa.array(cut(once), pa.binary()), pa.array(
            cut(twice), pa.binary())], names=["slice", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for _, lines, at, _ in _chunks(batches, least):
            row, hashes = lines.row[at], lines.hashes(at)
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            new = np.ones(len(at), bool)  # a key once for each of its documents
            new[1:] = (np.diff(row) != 0) | (np.diff(hashes) != 0)
            found.append(hashes[new])
            held += int(new.sum())
            if held >= KEYS:
                yield sent(found)
                found, held = [], 0
        if held:
            yield sent(found)

    return docs.mapInArrow(run, "slice int, once binary, twice binary")


def second_filter(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """(slice, bits): the filter of what two documents set, slice by slice; a task holds two slices at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array(
            [np.packbits(twice).tobytes()], pa.binary())], names=["slice", "bits"])
        for batch in batches:
            for piece, a, b in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if piece != current:
                    if current is not None:
                        yield done()
                    current, once, twice = piece, np.zeros(SLICE, bool), np.zeros(SLICE, bool)
                a = np.frombuffer(a, "<u2")
                twice[a] |= once[a]
                once[a] = True
                twice[np.frombuffer(b, "<u2")] = True
        if current is not None:
            yield done()

    return key_bits(docs, bits, least).repartition("slice").sortWithinPartitions("slice").mapInArrow(
        run, "slice int, bits binary")


def scan(docs: DataFrame, least: int, bits: int, held) -> DataFrame:
    """Rows of documents (doc_id, n_lines, suspected, packed) and of suspected keys (key, first, ids, numbers)."""
    names = ["doc_id", "n_lines", "suspected", "packed", "key", "first", "ids", "numbers"]
    lists = [pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        twice = held.value
        for ids, lines, at, texts in _chunks(batches, least):
            hashes = lines.hashes(at)
            places = marks(hashes, bits)
            passed = ((twice[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(0)
            at, hashes = at[passed], hashes[passed]
            suspected = np.zeros(len(ids), bool)
            suspected[lines.row[at]] = True
            n = len(ids)
            packed = [pack(t.as_buffer()) if t.is_valid else None for t in texts.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(lines.count.astype(np.int64)), pa.array(suspected), pa.array(packed, pa.binary()),
                *[pa.nulls(n, t) for t in (pa.binary(), pa.int64(), *lists)]], names=names)
            if not len(at):
                continue
            # Equal keys of the chunk become one row: grouped by hash, split where the bytes differ.
            keys = [lines.data[s:e].tobytes() for s, e in zip(lines.start[at].tolist(), lines.end[at].tolist())]
            which = pa.array(keys, pa.binary()).dictionary_encode()
            code = which.indices.to_numpy()
            doc = ids.fill_null(0).to_numpy()[lines.row[at]]
            order = np.lexsort((lines.number[at], doc, code))
            edge = np.searchsorted(code[order], np.arange(len(which.dictionary) + 1)).astype(np.int32)
            doc = doc[order]
            m = len(which.dictionary)
            # A key of one document in the chunk may still repeat in another chunk.
            yield pa.RecordBatch.from_arrays([
                *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.binary())], which.dictionary,
                pa.array(doc[edge[:-1]]), pa.ListArray.from_arrays(edge, pa.array(doc)), pa.ListArray.from_arrays(
                    edge, pa.array(lines.number[at][order].astype(np.int32)))], names=names)

    return docs.mapInArrow(run, "doc_id long, n_lines long, suspected boolean, packed binary, key binary, first long, "
                                "ids array<long>, numbers array<int>")


def kept_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of the rows (doc_id, n_lines, packed, gone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts, dropped = [], []
                for packed, gone in zip(part.column(2).to_pylist(), part.column(3)):
                    text = None if packed is None else _unpacked(packed)
                    gone = gone.values.to_numpy() if gone.is_valid else []
                    if len(gone):
                        lines = np.array(text.split(b"\n"), object)
                        stay = np.ones(len(lines), bool)
                        stay[gone] = False
                        text = b"\n".join(lines[stay])
                    texts.append(text)
                    dropped.append(len(gone))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(dropped, pa.int64()), pa.array(
                    texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    return rows.select("doc_id", "n_lines", "packed", "gone").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, text string")


def filter_bits(docs: DataFrame, per_key: int, most_bits: int) -> int:
    """Bits of a filter: ``per_key`` for each line, a power of two, one slice at least and ``most_bits`` at most."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    return int(min(most_bits, max(SLICE, 1 << int(lines * per_key - 1).bit_length())))


def dedup_lines(docs: DataFrame, least=10, per_key=12, most_bits=1 << 28, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, n_lines (before dropping), n_dropped and the text of the other lines."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    bits = filter_bits(docs, per_key, most_bits)
    twice = np.zeros(bits // 8, np.uint8)
    for row in second_filter(docs, bits, least).toLocalIterator():  # bounded by most_bits
        twice[row["slice"] * SLICE // 8:(row["slice"] + 1) * SLICE // 8] = np.frombuffer(row["bits"], np.uint8)
    rows = materialise(scan(docs, least, bits, spark.sparkContext.broadcast(twice)))
    suspects = rows.filter("key is not null")
    repeats = materialise(suspects.groupBy("key").agg(
        F.min("first").alias("least_id"), F.max(F.array_max("ids")).alias("largest")).filter("largest > least_id").select(
        "key", "least_id"))
    gone = suspects.select("key", "ids", "numbers").join(repeats, "key").select(
        "least_id", F.explode(F.arrays_zip("ids", "numbers")).alias("at")).filter(F.col("at.ids") != F.col("least_id")).groupBy(
        F.col("at.ids").alias("doc_id")).agg(F.collect_list("at.numbers").alias("gone"))  # at most the document's lines
    texts = rows.filter("key is null").select("doc_id", "n_lines", "packed", "suspected")
    return kept_lines(texts.filter("suspected").join(gone, "doc_id", "left").select("doc_id", "n_lines", "packed", "gone").unionAll(
        texts.filter("not suspected").select("doc_id", "n_lines", "packed", F.lit(None).cast("array<int>").alias("gone"))))


def without_repeated_lines(docs: DataFrame, doc_id="doc_id", text="text", **options) -> DataFrame:
    """``docs`` with the repeated lines cut out of the text; rows without an id stay as they are."""
    found = dedup_lines(docs, doc_id=doc_id, text=text, **options).filter("n_dropped > 0").select(
        F.struct(F.col("doc_id").alias("id"), "text").alias("found"))
    whole = docs.select(F.struct("*").alias("row")).join(found, F.col(f"row.`{doc_id}`") == F.col("found.id"), "left")
    return whole.select(*[F.when(F.col("found").isNotNull(), F.col("found.text")).otherwise(F.col(f"row.`{c}`")).alias(c)
                          if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
