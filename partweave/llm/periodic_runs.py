"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are identical) that holds at least two periods and
``least`` words and that no neighbouring word extends.  Documents do not share runs, so the work is narrow: a task
takes about a megabyte of text at a time, numbers its words and finds all runs of these documents together.

1. Direct lag scans find the periods below ``DIRECT``: words are compared with the words 1, 2, ... places on.
2. For longer periods each scale Q = 24, 48, 96, ... slides a window of Q words over the documents of at least 2Q words
   and selects the word group of Q/2 words with the least hash in it.  A run of a period q in [Q, 2Q) holds two equal
   windows q apart, so their minima are equal and q apart: equal minima at such distances seed lag q, and the seed is
   extended word by word to both sides.
3. Groups inside a run of a period up to Q/4, which earlier scales have found, repeat all along it and are no minima.
   A window of nothing else lies inside one such run R.  If all windows of a period are of this kind, the period goes
   from R to the next run of R's period that begins where R ends or a little before; the lags between those two are
   seeds as well, at most one for each period of R.

Seeds of one lag in one stretch are extended once.  A stretch found with two periods has the smaller one.

Defined results: null, empty and blank texts have no words and no runs; words are compared as they stand; repeated rows
get equal results; ids are not read, so they may be null or repeat; extra columns are kept by ``periodic_runs``,
but for one that has the name of a result and is replaced, as ``withColumn`` would; an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import slices
from .fingerprints import mixed, sliding_min

DIRECT, LEAST, CHUNK = 24, 12, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _reach(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch around ``at`` whose words equal the words ``lag`` places on; (at, at) if there is none."""
    n = len(words) - lag
    if words[at] != words[at + lag]:
        return at, at
    end, step = at + 1, 64
    while end < n:
        stop = min(n, end + step)
        off = np.flatnonzero(words[end:stop] != words[end + lag:stop + lag])
        if len(off):
            end += int(off[0])
            break
        end, step = stop, 2 * step
    begin, step = at, 64
    while begin > 0:
        stop = max(0, begin - step)
        off = np.flatnonzero(words[stop:begin] != words[stop + lag:begin + lag])
        if len(off):
            begin = stop + int(off[-1]) + 1
            break
        begin, step = stop, 2 * step
    return begin, end


def _pairs(values: np.ndarray, places: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with equal values and a distance in [lo, hi): place and distance."""
    order = np.lexsort((places, values))
    value, place = values[order], places[order]
    out, step = [], 1
    left = np.arange(len(place))
    while True:  # the step-th next place of the same value, as long as it is near enough
        left = left[left + step < len(place)]
        left = left[(value[left] == value[left + step]) & (place[left + step] - place[left] < hi)]
        if not len(left):
            break
        far = place[left + step] - place[left]
        out.append((place[left][far >= lo], far[far >= lo]))
        step += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in out]), np.concatenate([d for _, d in out])


class _Runs:
    """Runs found so far in one array of words; the smallest period of each stretch."""

    def __init__(self, words: np.ndarray, least: int):
        self.words, self.least, self.found = words, least, {}

    def add(self, begin: int, end: int, period: int) -> None:
        """The stretch [begin, end) of equal words ``period`` apart; its run ends a period later."""
        if end - begin >= period and end - begin + period >= self.least:
            key = (begin, end + period)
            if period < self.found.get(key, period + 1):
                self.found[key] = period

    def seeds(self, places: np.ndarray, lags: np.ndarray) -> None:
        order = np.lexsort((places, lags))
        lag, end = -1, 0
        for at, d in zip(places[order].tolist(), lags[order].tolist()):
            if d == lag and at < end:
                continue
            begin, end = _reach(self.words, at, d)
            lag = d
            self.add(begin, end, d)

    def rows(self) -> np.ndarray:
        """(begin, end, period) by begin."""
        return np.array(sorted((b, e, p) for (b, e), p in self.found.items()), np.int64).reshape(-1, 3)


def _neighbour_seeds(runs: np.ndarray, words: np.ndarray, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Lags in [lo, hi) from a run to the next run of the same period, where they touch or overlap."""
    places, lags = [], []
    last: dict[int, tuple[int, int]] = {}
    for begin, end, p in runs.tolist():
        before = last.get(p)
        last[p] = (begin, end)
        if before is None or before[1] < begin or 4 * p > lo:
            continue
        # The phase: the place in the earlier run's last period from which the later run's first period is repeated.
        head = words[begin:begin + p]
        for j in range(p):
            at = before[1] - p - j
            if at >= before[0] and np.array_equal(words[at:at + p], head):
                first = begin - at
                far = np.arange(first + max(0, -(-(lo - first) // p)) * p, min(hi, before[1] - before[0] + 1, end - begin + 1), p)
                far = far[far >= lo]
                places += [max(before[0], begin - d) for d in far.tolist()]
                lags += far.tolist()
                break
    return places, lags


def find_runs(words: np.ndarray, texts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs (begin, end, period) of an array of word numbers.  ``texts`` are the bounds of the documents in it; each
    ends with a number of its own, so that no run goes across."""
    runs = _Runs(words, least)
    sizes = np.diff(texts)
    for p in range(1, DIRECT):
        if len(words) > p:
            begin, end = _stretches(words[p:] == words[:-p])
            long = np.flatnonzero(end - begin >= max(p, least - p))
            for b, e in zip(begin[long].tolist(), end[long].tolist()):
                runs.add(b, e, p)
    scale = DIRECT
    while True:
        at = np.flatnonzero(sizes - 1 >= 2 * scale)
        if not len(at):
            return runs.rows()
        # The documents long enough, one after the other: each brings its closing number along.
        known = runs.rows()
        place = np.concatenate([[0], np.cumsum(sizes[at])])
        shift = texts[at] - place[:-1]
        where = np.arange(place[-1]) + np.repeat(shift, sizes[at])
        doc = np.searchsorted(texts, known[:, 0], "right") - 1
        mine = np.searchsorted(at, doc)
        held = (mine < len(at)) & (at[np.minimum(mine, len(at) - 1)] == doc)
        inside = known[held] - np.stack([shift[mine[held]]] * 2 + [np.zeros(held.sum(), np.int64)], 1)
        places, lags = _scale_seeds(words[where], scale, inside)
        runs.seeds(where[places], lags)
        scale *= 2


def _scale_seeds(words: np.ndarray, scale: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, k = len(words), scale // 2
    window = scale - k + 1
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
    undo = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words.astype(np.uint64) + np.uint64(1)) * powers[:n])])
    groups = mixed((sums[k:] - sums[:-k]) * undo[:n - k + 1])
    index = np.arange(len(groups), dtype=np.uint64)
    top = np.uint64(0xFFFFFFFF)
    periodic = np.zeros(len(groups) + 1, np.int64)
    short = known[known[:, 2] * 2 <= k]
    inner = short[short[:, 1] - short[:, 0] >= k]
    np.add.at(periodic, inner[:, 0], 1)
    np.add.at(periodic, inner[:, 1] - k + 1, -1)
    periodic = np.cumsum(periodic)[:len(groups)] > 0
    # The high half of the hash, then the leftmost place; groups inside short periods come last.
    keys = np.where(periodic, top, np.minimum(groups >> np.uint64(32), top - np.uint64(1))) << np.uint64(32) | index
    least = np.unique(sliding_min(keys, window) & top).astype(np.int64)
    least = least[~periodic[least]]
    places, lags = _pairs(groups[least], least, scale, 2 * scale)
    more, far = _neighbour_seeds(short, words, scale, 2 * scale)
    return np.concatenate([places, np.array(more, np.int64)]), np.concatenate([lags, np.array(far, np.int64)])


def collapsed_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if a run keeps its first period only."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    return np.cumsum(gone)[:n] == 0


def periodic_runs(docs: DataFrame, text="text", least=LEAST, runs="runs", collapsed: str | None = None) -> DataFrame:
    """Add ``runs``, an array of (start, length, period) in words by start and period, and on request the text whose
    runs are collapsed to their first period, words joined by one space."""
    at = docs.columns.index(text)
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    extra = [T.StructField(runs, kind)] + ([T.StructField(collapsed, T.StringType())] if collapsed else [])
    stay = [i for i, c in enumerate(docs.columns) if c not in {e.name for e in extra}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, CHUNK):
                split = [t.encode().split() if t else [] for t in part.column(at).to_pylist()]
                sizes = np.array([len(w) for w in split], np.int64)
                texts = np.concatenate([[0], np.cumsum(sizes + 1)])
                flat = pa.array([w for doc in split for w in doc], pa.binary()).dictionary_encode()
                words = np.zeros(texts[-1], np.int64)
                inside = np.ones(texts[-1], bool)
                inside[texts[1:] - 1] = False
                words[inside] = flat.indices.to_numpy()
                words[texts[1:] - 1] = len(flat.dictionary) + np.arange(len(split))
                found = find_runs(words, texts, least)
                doc = np.searchsorted(texts, found[:, 0], "right") - 1
                edge = np.searchsorted(doc, np.arange(len(split) + 1)).astype(np.int32)
                start = found[:, 0] - texts[doc]
                rows = pa.StructArray.from_arrays([pa.array(start), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])],
                                                  names=["start", "length", "period"])
                columns = [*[part.column(i) for i in stay], pa.ListArray.from_arrays(edge, rows)]
                if collapsed:
                    kept = []
                    for i, doc_words in enumerate(split):
                        mine = found[edge[i]:edge[i + 1]] - np.array([[texts[i], texts[i], 0]])
                        if len(mine):
                            first = collapsed_words(len(doc_words), mine)
                            doc_words = [w for w, f in zip(doc_words, first.tolist()) if f]
                        kept.append(b" ".join(doc_words))
                    columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*[docs.schema.fields[i] for i in stay], *extra])
    names = schema.fieldNames()
    return docs.mapInArrow(run, schema)
