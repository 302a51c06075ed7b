"""Personal data: fixed patterns plus a semi-Markov conditional random field over whole candidate spans.

Text around digits and ``@`` (a zone) is cut into atoms: runs of digits, runs of letters, single other characters.
A segment is up to ``LONGEST`` atoms with a type, or one atom outside.  Whole-span features (digit count, checksum,
four octets, first and last character, what stands on either side, ...) score every segment; dynamic programming over
entity segments of bounded length picks boundaries and types together.  Weights maximise the conditional likelihood
of the pattern spans on a bounded sample of zones (``training_zones``, those of least hash); every zone is decoded.

Defined results: null and empty texts have no spans; spans of the model that touch a pattern span are dropped, since
that text is reported already; equal positions order by kind; repeated rows are scanned one by one; extra columns are
not read by ``pii_spans`` and kept by ``mask_pii``; a table too small to train on gets the pattern spans alone.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, cell, unboxed
from .fingerprints import byte_chunks

#: Fixed values of the contract.
KINDS = ["email", "ip", "card", "phone"]
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit before cannot start a match that the longer start would miss; the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

LONGEST = 28
BLOCK = 4096
SPANS = "array<struct<start:long,end:long,rank:int,kind:string>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches found from each ``@``, so that long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the contract's patterns, by kind and start."""
    out = [(s, e, 0) for s, e in emails(text)]
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


_HOT = np.zeros(256, bool)
_HOT[[0x40, *range(0x30, 0x3A)]] = True
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]", re.S)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HOT_CHARACTER = re.compile(r"[0-9@]")
# Classes of atoms
_CLASS = {"+": 2, "(": 3, ")": 4, ".": 5, "-": 6, "@": 7, "_": 8, "%": 8} | dict.fromkeys(" \t\n\r\x0b\x0c", 9)
_DIGITS, _LETTERS, _OTHER, _EDGE = 0, 1, 10, 11


def zones(text: str) -> list[tuple[int, int]]:
    """Neighbouring words with a digit or ``@``, and one bracketed or plain word between two of them."""
    out: list[list[int]] = []
    for m in _HOT_CHARACTER.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        start = m.start()
        while start and text[start - 1] not in " \t\n\r\x0b\x0c":
            start -= 1
        end = _WORD.match(text, m.start()).end()
        if out and start - out[-1][1] <= 1:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def _bucket(x: np.ndarray, edges: list[int]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right")


_SIZES = [12, 12, 11, 3, 5, 2, 3, 4, 2, 12, 12, 4, 132, 180]
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)])
N_FEATURES = int(_OFFSETS[-1]) + 1  # the last is the bias


class Zone:
    """Atoms of a zone with the prefix sums that give the features of any segment."""

    def __init__(self, text: str):
        atoms = _ATOM.findall(text)
        self.n = len(atoms)
        first = [a[0] for a in atoms]
        self.kind = np.array([_DIGITS if "0" <= c <= "9" else _LETTERS if "A" <= c <= "Z" or "a" <= c <= "z"
                              else _CLASS.get(c, _OTHER) for c in first])
        size = np.array([len(a) for a in atoms])
        self.at = np.concatenate([[0], np.cumsum(size)])
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.digits = total(np.where(self.kind == _DIGITS, size, 0))
        self.letters = total(np.where(self.kind == _LETTERS, size, 0))
        self.dots, self.ats, self.spaces, self.others = [total(self.kind == k) for k in (5, 7, 9, 10)]
        octet = np.array([k == _DIGITS and (s <= 3 and int(a) <= 255) for a, k, s in zip(atoms, self.kind, size)])
        octet = np.concatenate([octet, np.zeros(7, bool)])
        dot = np.concatenate([self.kind == 5, np.zeros(7, bool)])
        self.quad = np.logical_and.reduce([octet[i:i + self.n] if i % 2 == 0 else dot[i:i + self.n] for i in range(7)])
        self.only_digits = "".join(a for a, k in zip(atoms, self.kind) if k == _DIGITS)
        self.edges = np.concatenate([[_EDGE], self.kind, [_EDGE]])

    def features(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, valid) of the segments that start in [begin, end): codes is (starts, LONGEST, features)."""
        i = np.arange(begin, end)[:, None]
        j = i + np.arange(1, LONGEST + 1)[None, :]
        valid = j <= self.n
        j = np.minimum(j, self.n)
        of = lambda sums: sums[j] - sums[i]
        first = np.broadcast_to(self.kind[i], j.shape)
        digits, dots, ats = of(self.digits), of(self.dots), of(self.ats)
        count = _bucket(digits, [1, 4, 7, 8, 11, 13, 16, 17, 20, 26])
        quad = self.quad[i] & (j - i == 7)
        checked = np.zeros(j.shape, np.int64)
        for a, b in zip(*np.nonzero(valid & (digits >= 13) & (digits <= 19) & (of(self.letters) == 0))):
            checked[a, b] = 1 + luhn(self.only_digits[self.digits[i[a, 0]]:self.digits[j[a, b]]])
        right = self.edges[j + 1]
        codes = [first, self.kind[j - 1], count, np.minimum(ats, 2), np.minimum(dots, 4), quad, checked,
                 _bucket(of(self.letters), [1, 4, 9]), of(self.others) > 0, np.broadcast_to(self.edges[i], j.shape), right,
                 _bucket(of(self.spaces), [1, 2, 4]), first * 11 + count,
                 (np.minimum(ats, 2) * 5 + np.minimum(dots, 4)) * 12 + right]
        return np.stack([c + o for c, o in zip(codes, _OFFSETS)], -1), valid

    def scores(self, weights: np.ndarray, begin: int, end: int) -> np.ndarray:
        """(starts, LONGEST, kinds); segments beyond the zone score minus infinity."""
        codes, valid = self.features(begin, end)
        found = weights.T[codes].sum(2) + weights[:, -1]
        return np.where(valid[..., None], found, -np.inf)

    def decode(self, weights: np.ndarray, margin: float) -> list[tuple[int, int, int]]:
        """(start, end, kind number) in characters, on the best segmentation."""
        n = self.n
        best, back, label = np.full(n + LONGEST + 1, -np.inf), np.zeros(n + LONGEST + 1, np.int64), np.full(n + LONGEST + 1, -1)
        best[0] = 0.0
        for begin in range(0, n, BLOCK):
            found = self.scores(weights, begin, min(n, begin + BLOCK)) - margin
            kind, top = found.argmax(2), found.max(2)
            for k in range(len(top)):
                i = begin + k
                reach = best[i] + top[k]
                if best[i] > best[i + 1]:  # one atom outside
                    best[i + 1], back[i + 1], label[i + 1] = best[i], i, -1
                better = reach > best[i + 1:i + 1 + LONGEST]
                if better.any():
                    at = i + 1 + np.flatnonzero(better)
                    best[at], back[at], label[at] = reach[better], i, kind[k][better]
        out, j = [], n
        while j > 0:
            if label[j] >= 0:
                out.append((int(self.at[back[j]]), int(self.at[j]), int(label[j])))
            j = int(back[j])
        return out[::-1]

    def gradient(self, weights: np.ndarray, gold: list[tuple[int, int, int]]) -> np.ndarray:
        """Observed minus expected feature counts; ``gold`` holds (first atom, end atom, kind)."""
        n = self.n
        codes, _ = self.features(0, n)
        found = self.scores(weights, 0, n)
        forward, backward = np.full(n + LONGEST + 1, -np.inf), np.full(n + LONGEST + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        mass = np.logaddexp.reduce(found, axis=2)
        for i in range(n):
            forward[i + 1:i + 1 + LONGEST] = np.logaddexp(forward[i + 1:i + 1 + LONGEST], forward[i] + mass[i])
            forward[i + 1] = np.logaddexp(forward[i + 1], forward[i])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp(np.logaddexp.reduce(mass[i] + backward[i + 1:i + 1 + LONGEST]), backward[i + 1])
        after = backward[np.arange(n)[:, None] + np.arange(1, LONGEST + 1)[None, :]]
        chance = np.exp(forward[:n, None, None] + found + after[..., None] - forward[n])
        out = np.zeros_like(weights)
        for kind in range(len(weights)):
            p = chance[..., kind]
            np.subtract.at(out[kind], codes.reshape(-1, codes.shape[-1]), np.repeat(p.reshape(-1, 1), codes.shape[-1], 1))
            out[kind, -1] -= p.sum()
        for i, j, kind in gold:
            out[kind, codes[i, j - i - 1]] += 1
            out[kind, -1] += 1
        return out


def fit(sample: list[str], rounds: int = 8, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights (kinds, features) from zones labelled by the patterns, by adaptive gradient ascent."""
    weights, seen = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-8)
    data = []
    for text in sample:
        zone, gold, free = Zone(text), [], 0
        place = {int(p): i for i, p in enumerate(zone.at)}
        for s, e, kind in sorted(pattern_spans(text)):
            if s >= free and s in place and e in place and place[e] - place[s] <= LONGEST:
                gold.append((place[s], place[e], kind))
                free = e
        if 0 < zone.n <= 200:
            data.append((zone, gold))
    for _ in range(rounds):
        for zone, gold in data:
            g = zone.gradient(weights, gold) - decay * weights
            seen += g * g
            weights += rate * g / np.sqrt(seen)
    return weights


def training_sample(docs: DataFrame, training_zones: int, doc_id: str, text: str) -> list[str]:
    """At most ``training_zones`` zones, those of least hash, an equal share for each pattern and for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for begin, end, data, offsets in byte_chunks(batch.column(1), 1 << 20):
                hot = np.concatenate([[0], np.cumsum(_HOT[data])])
                for row in np.flatnonzero(hot[offsets[1:]] > hot[offsets[:-1]]):
                    t = batch.column(1)[begin + int(row)].as_py()
                    for s, e in zones(t):
                        if e - s <= 200:
                            kinds = {k for *_, k in pattern_spans(t[s:e])}
                            found.append((t[s:e], min(kinds, default=len(KINDS))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], names=["zone", "kind"])

    share = training_zones // (len(KINDS) + 1)
    labelled = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "zone string, kind int")
    # Many more zones than the share are drawn, since kinds differ in frequency; the draw is bounded too.
    drawn = labelled.distinct().orderBy(F.xxhash64("zone"), "zone").limit(20 * training_zones).collect()
    out, taken = [], {}
    for r in drawn:
        taken[r["kind"]] = taken.get(r["kind"], 0) + 1
        if taken[r["kind"]] <= share:
            out.append(r["zone"])
    return out


def scan(text: str, weights: np.ndarray, margin: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Pattern spans and the spans that the model adds."""
    base = pattern_spans(text)
    extra = []
    for s, e in zones(text):
        inside = [b for b in base if b[0] < e and s < b[1]]
        for a, b, kind in Zone(text[s:e]).decode(weights, margin):
            if not any(x[0] < s + b and s + a < x[1] for x in inside):
                extra.append((s + a, s + b, kind))
    return base, extra


def pii_spans(docs: DataFrame, doc_id="doc_id", text="text", training_zones=400, margin=2.0, masked: str | None = None) -> DataFrame:
    """One row per document: ``base`` and ``extra`` spans; ``masked`` names a column for the text with every span
    replaced by its kind in brackets."""
    weights = fit(training_sample(docs, training_zones, doc_id, text))
    array = lambda spans: [{"start": s, "end": e, "rank": k, "kind": KINDS[k]} for s, e, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in byte_chunks(batch.column(1), 1 << 20):
                hot = np.concatenate([[0], np.cumsum(_HOT[data])])
                found = [((), ())] * (end - begin)
                texts = batch.column(1)[begin:end]
                changed = {}
                for row in np.flatnonzero(hot[offsets[1:]] > hot[offsets[:-1]]).tolist():
                    t = texts[row].as_py()
                    found[row] = scan(t, weights, margin)
                    if masked and (found[row][0] or found[row][1]):
                        changed[row] = mask(t, [*found[row][0], *found[row][1]])
                columns = [batch.column(0)[begin:end], *[pa.array([array(f[i]) for f in found], spans_type) for i in (0, 1)]]
                if masked:
                    columns.append(pa.array([changed.get(i, None) for i in range(end - begin)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rank", pa.int32()), ("kind", pa.string())]))
    names = ["doc_id", "base", "extra", *([masked] if masked else [])]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id long, base {SPANS}, extra {SPANS}" + (f", {masked} string" if masked else ""))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replace spans; overlapping ones become one, named after the first."""
    out, at, end = [], 0, -1
    for s, e, kind in sorted(spans):
        if s >= end:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, doc_id="doc_id", text="text", **options) -> DataFrame:
    """``docs`` with personal data masked; texts without any stay as they are."""
    changed = pii_spans(docs, doc_id, text, masked="masked", **options).filter("masked is not null").select(
        "doc_id", "masked").hint("shuffle_hash")
    return unboxed(boxed(docs).join(changed, cell(doc_id) == F.col("doc_id"), "left"), docs.columns, **{
        text: F.coalesce("masked", cell(text))})


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
