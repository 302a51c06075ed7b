"""Exact substring dedup by bucket-pointer refinement over a sparse suffix sample.

A byte goes if a ``width``-byte string that covers it also starts anywhere else.  Sorting every suffix of the corpus
would shuffle many times its size, so the suffixes that enter the buckets are a sample that depends on content alone:
of the ``q``-grams inside a ``width``-byte string the one with the least fingerprint is its anchor, so equal strings
have equal anchors at equal offsets.  Strings that follow one another with the same anchor form a run, one row each.

1. Initial buckets: runs by the ``q``-gram at their anchor.  Buckets with one entry are final and leave.
2. Refinement: what is left is split by the bucket identifiers of the later (and earlier) offsets that the run's
   strings reach, all at once as one identifier of the run's extent.  A bucket with two entries repeats whole.
3. Recursion: in buckets that still hold different runs, one run of each kind is cut into blocks of starts at fixed
   distances from the anchor.  A block is refined by the identifier of the bytes that its strings have in common;
   blocks alone in their bucket are final, and what is left is refined by the identifier of each whole string, made
   of the ``q``-gram identifiers at its start and ``q`` bytes on.

Identifiers are 64-bit fingerprints compared only inside one anchor bucket.  Buckets are counted with partial
aggregation and met again by joins, so no bucket is gathered in a task, and a group of k equal runs is one run
afterwards: nothing is compared pairwise.  Rows shuffled: one per run (about width / 4 bytes of text each) and the
starts of the runs at the ends of repeats.

Defined results: null text is empty; a text shorter than ``width`` bytes keeps all; a string that repeats inside its
own document counts, overlapping itself too; repeated documents lose every byte if they are long enough; ids must be
unique; extra columns are not read; an empty table gives an empty table.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, cell, materialise, unboxed
from .fingerprints import Prefixes, byte_chunks, mixed, sliding_min

CHUNK = 1 << 20
STEP = 16
_INDEX = np.uint64((1 << 24) - 1)


def runs_of(data: np.ndarray, offsets: np.ndarray, width: int, q: int):
    """Runs of the documents in ``data``: row, start in the document, shape, anchor and extent ids.

    The shape is 1024 times the anchor's distance from the start, plus the number of starts."""
    out = []
    if len(offsets) == 2 and len(data) > CHUNK:  # one long document: pieces that overlap by a string
        for at in range(0, max(1, len(data) - width + 1), CHUNK):
            piece = data[at:at + CHUNK + width - 1]
            out.append([c + at if i == 1 else c for i, c in enumerate(_runs(piece, np.array([0, len(piece)]), width, q))])
    else:
        out.append(_runs(data, offsets, width, q))
    return [np.concatenate(c) for c in zip(*out)]


def _runs(data: np.ndarray, offsets: np.ndarray, width: int, q: int):
    none = np.zeros(0, np.int64)
    long = np.diff(offsets) >= width
    if not long.any():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefixes = Prefixes(data)
    grams = prefixes.windows(q)
    keys = (grams & ~_INDEX) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal grams
    anchors = (sliding_min(keys, width - q + 1) & _INDEX).astype(np.int64)
    inside = np.zeros(len(data) + 2, np.int64)
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - width + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:len(anchors)]))
    anchors = anchors[starts]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchors) != 0) | (np.diff(starts) != 1)]))
    begin, anchor = starts[first], anchors[first]
    count = np.diff(np.concatenate([first, [len(starts)]]))
    extent = mixed(prefixes.of(begin, begin + count + (width - 1)) + mixed(
        ((anchor - begin) * 1024 + count).astype(np.uint64)))
    row = np.searchsorted(offsets, begin, "right") - 1
    return row, begin - offsets[row], (anchor - begin) * 1024 + count, grams[anchor], extent


def text_runs(docs: DataFrame, width: int, q: int) -> DataFrame:
    """(anchor, extent, doc_id, start, shape) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, end, data, offsets in byte_chunks(batch.column(1), CHUNK):
                row, start, shape, anchor, extent = runs_of(data, offsets, width, q)
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), pa.array(extent.view(np.int64)), pa.array(ids[begin:end][row], pa.int64()),
                    pa.array(start.astype(np.int32)), pa.array(shape.astype(np.int32))],
                    names=["anchor", "extent", "doc_id", "start", "shape"])

    return docs.mapInArrow(run, "anchor long, extent long, doc_id long, start int, shape int")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts compressed one by one, because they cross the network for the last two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [pack((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def _unpacked(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def open_buckets(rows: DataFrame, *key: str) -> DataFrame:
    """Buckets with two entries or more, with their number of entries."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1")


def opened_blocks(runs: DataFrame, texts: DataFrame, width: int, q: int) -> DataFrame:
    """Blocks of ``STEP`` starts of the runs (anchor, doc_id, start, shape, single).

    Columns: anchor, block (distance of the anchor in steps), core (identifier of the common bytes), doc_id, single,
    start (of the first string) and strings (identifiers, one for each start)."""
    per_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "shape", "single")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, packed, runs in zip(*[batch.column(i) for i in range(3)]):
                prefixes = Prefixes(np.frombuffer(_unpacked(packed.as_py()), np.uint8))
                fields = [runs.values.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
                for at in range(0, len(fields[0]), 4096):
                    anchor, start, shape, single = [f[at:at + 4096] for f in fields]
                    n, place = shape % 1024, start.astype(np.int64) + shape // 1024
                    which = np.repeat(np.arange(len(n)), n)
                    p = start[which].astype(np.int64) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    block = (place[which] - p) // STEP
                    strings = mixed(prefixes.of(p, p + q) + mixed(prefixes.of(p + q, p + width)))
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 0) | (np.diff(block) != 0)]))
                    which, block = which[first], block[first]
                    left = place[which] - STEP * block
                    core = mixed(prefixes.of(left, left + width - STEP + 1))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(anchor[which]), pa.array(block.astype(np.int32)), pa.array(core.view(np.int64)),
                        pa.array(np.full(len(first), key.as_py(), np.int64)), pa.array(single[which]),
                        pa.array(p[first].astype(np.int32)), pa.ListArray.from_arrays(
                            np.concatenate([first, [len(p)]]).astype(np.int32), strings.view(np.int64))], names=names)

    names = ["anchor", "block", "core", "doc_id", "single", "start", "strings"]
    return texts.join(per_doc.hint("shuffle_hash"), "doc_id").select("doc_id", "packed", "runs").mapInArrow(
        run, "anchor long, block int, core long, doc_id long, single boolean, start int, strings array<long>")


def repeated_spans(docs: DataFrame, texts: DataFrame, width=200, q=100) -> DataFrame:
    """(doc_id, start, end): byte ranges whose every ``width``-byte string repeats; ranges may overlap."""
    # 1: runs outside singleton buckets; written, since three steps read them.  All runs are read twice, to count the
    #    buckets and to be joined with them, so they stay on disk that long.
    runs = text_runs(docs, width, q).persist(StorageLevel.DISK_ONLY)
    anchors = open_buckets(runs, "anchor").select("anchor")
    left = materialise(runs.join(anchors.hint("shuffle_hash"), "anchor", "left_semi"))
    runs.unpersist()
    # 2: by the whole extent.
    kinds = left.groupBy("anchor", "extent").agg(
        F.count(F.lit(1)).alias("entries"), F.min(F.struct("doc_id", "start", "shape")).alias("one"))
    whole = left.join(kinds.filter("entries > 1").select("anchor", "extent"), ["anchor", "extent"], "left_semi").select(
        "doc_id", "start", (F.col("start") + F.col("shape") % 1024 + (width - 1)).alias("end"))
    # 3: one run of each kind where a bucket holds several kinds.
    #    Kinds with two entries repeat whole, so a bucket is opened only for kinds that have one.
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("entries").alias("least")).filter(
        "n > 1 and least = 1").select("anchor")
    differing = kinds.join(several, "anchor", "left_semi").select(
        "anchor", "one.doc_id", "one.start", "one.shape", (F.col("entries") == 1).alias("single"))
    blocks = materialise(opened_blocks(differing, texts, width, q))
    key = ["anchor", "block", "core"]
    wanted = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("single")).filter(
        "n > 1 and single").select(*key)
    alike = materialise(blocks.join(wanted, key, "left_semi"))
    strings = alike.select("anchor", "doc_id", "single", "start", F.posexplode("strings").alias("i", "string")).select(
        "anchor", "string", "doc_id", "single", (F.col("start") + F.col("i")).alias("start"))
    key = ["anchor", "string"]
    parts = strings.filter("single").join(open_buckets(strings, *key).select(*key), key, "left_semi").select(
        "doc_id", "start", (F.col("start") + width).alias("end"))
    return whole.unionAll(parts)


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by (start, end) rows."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(spans) - 1]])
    return list(zip(spans[first, 0].tolist(), reach[last].tolist()))


def dedup_substrings(docs: DataFrame, width=200, doc_id="doc_id", text="text", with_kept=False) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256 and the removed spans; ``with_kept`` gives
    only the documents that lose bytes, with those that remain."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = packed_texts(docs)
    spans = repeated_spans(docs, texts, width, width // 2).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))  # bounded by the document's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = []
                for packed, found in zip(part.column(1), part.column(2)):
                    data = _unpacked(packed.as_py())
                    gone = merged(np.stack([found.values.field(i).to_numpy() for i in (0, 1)], 1)) if found.is_valid else []
                    kept = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in gone]], [*[s for s, _ in gone], len(data)]))
                    rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(),
                                 [{"start": s, "end": e} for s, e in gone], kept))
                columns = list(zip(*rows))[:len(types)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), *([pa.binary()] if with_kept else [])]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if with_kept else [])]
    found = texts.join(spans.hint("shuffle_hash"), "doc_id", "inner" if with_kept else "left")
    return found.select("doc_id", "packed", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
             "spans array<struct<start:long,end:long>>" + (", kept binary" if with_kept else ""))


def without_repeats(docs: DataFrame, width=200, doc_id="doc_id", text="text") -> DataFrame:
    """``docs`` with the repeats cut out of the text; bytes of a character that a cut has split go with the cut."""
    kept = dedup_substrings(docs, width, doc_id, text, with_kept=True).select("doc_id", "kept").hint("shuffle_hash")
    whole = F.expr("try_validate_utf8(cast(kept as string))")
    cut = F.regexp_replace(F.expr("make_valid_utf8(cast(kept as string))"), "\\uFFFD", "")
    return unboxed(boxed(docs).join(kept, cell(doc_id) == F.col("doc_id"), "left"), docs.columns, **{
        text: F.when(F.col("doc_id").isNull(), cell(text)).otherwise(F.coalesce(whole, cut))})
