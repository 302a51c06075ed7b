"""Near-duplicate documents: MinHash bands propose pairs, a sequential Bayesian test prunes them, full sets decide.

A document is its set of distinct ``k``-word shingles.  Equal sets are one class before anything is compared.  Bands of
signature rows put classes into buckets; a bucket never emits its pairs.  Its members meet its centre, the member that
shares most bucket places, which in a group of copies is the original.  Members that this leaves outside the centre's
component then meet the members of other components, block by block and by signature, unless their distances to the
centre rule a link out; texts move only to blocks in which a member has partners left.  So no pair of a bucket is left out: pairs inside a component are settled by transitivity.

Verification compares 16 signature values at a time and drops a pair as soon as the posterior probability that its
similarity reaches the threshold (uniform prior) falls under ``miss``; survivors are confirmed on their full sets.
With 48 bands of 6 rows a pair at similarity 0.8 shares no bucket with probability 5e-7, less above.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; a text with fewer than
``k`` words is one shingle, its whole sequence; repeated rows with ids of their own are linked; ids must be unique;
extra columns are not read by ``near_duplicates``; an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import materialise
from .fingerprints import Prefixes, byte_chunks, mixed
from .suffix_dedup import packed_texts, _unpacked

BANDS, ROWS, SIGNATURE, BATCH = 48, 6, 128, 16
BLOCK = 256
#: Shingles of residents that a task keeps unpacked.
KEPT = 4_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIERS = (mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = (mixed(np.arange(5001, 5001 + BANDS * ROWS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_STEPS = mixed(np.arange(9001, 9009, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle fingerprint), sorted and distinct, of the texts that ``offsets`` cut out of ``data``."""
    data = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1] if len(data) else word
    after = np.concatenate([word[1:], [False]]) & ~edge[1:] if len(data) else word
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    words = mixed(Prefixes(data).of(starts, ends) + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    rows, shingles = [], []
    if len(words) >= k:
        whole = row[k - 1:] == row[:len(row) - k + 1]
        value = sum((words[i:len(words) - k + 1 + i] * _STEPS[i] for i in range(k)), np.uint64(0))
        rows.append(row[:len(row) - k + 1][whole])
        shingles.append(mixed(value)[whole])
    short = (n_words > 0) & (n_words < k)
    if short.any():  # the whole sequence as one shingle
        at = short[row]
        first = np.flatnonzero(np.concatenate([[True], np.diff(row[at]) != 0]))
        position = np.arange(at.sum()) - np.repeat(first, np.diff([*first, at.sum()]))
        rows.append(row[at][first])
        shingles.append(mixed(np.add.reduceat(words[at] * _STEPS[position], first) + np.uint64(1)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows, shingles = np.concatenate(rows), np.concatenate(shingles)
    order = np.argsort(rows, kind="stable")  # short texts come after the others: two sorted runs
    rows, shingles = rows[order], shingles[order]
    edges = np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        shingles[begin:end].sort()
    new = np.concatenate([[True], (np.diff(rows) != 0) | (np.diff(shingles) != 0)])
    return rows[new], shingles[new]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, signature) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for begin, end, data, offsets in byte_chunks(batch.column(1), 1 << 20):
                n = end - begin
                row, shingle = shingle_sets(data, offsets, k)
                count = np.bincount(row, minlength=n)
                some = np.flatnonzero(count)
                ids_ab = np.zeros((2, n), np.uint64)
                minima = np.zeros((BANDS * ROWS, n), np.uint32)
                if len(some):
                    first = np.concatenate([[0], np.cumsum(count[some])[:-1]])
                    ids_ab[0, some] = np.add.reduceat(mixed(shingle), first)
                    ids_ab[1, some] = np.add.reduceat(mixed(shingle ^ _STEPS[0]), first)
                    x = (shingle >> np.uint64(32)).astype(np.uint32)
                    for i in range(BANDS * ROWS):
                        minima[i, some] = np.minimum.reduceat(x * _MULTIPLIERS[i] + _ADDENDS[i], first)
                wide = minima.astype(np.uint64)
                keys = np.stack([mixed(sum((wide[b * ROWS + r] * _STEPS[r] for r in range(ROWS)), np.uint64(b + 1)))
                                 for b in range(BANDS)], 1)
                low = np.ascontiguousarray((minima[:SIGNATURE].T & np.uint32(0xFFFF)).astype("<u2"))
                yield pa.RecordBatch.from_arrays([
                    ids[begin:end], pa.array(count.astype(np.int64)),
                    pa.array(ids_ab[0].view(np.int64)), pa.array(ids_ab[1].view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), keys.view(np.int64).ravel()),
                    pa.array([r.tobytes() for r in low], pa.binary())], names=names)

    names = ["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"]
    return docs.mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary")


def least_matches(percent: int, miss: float) -> list[int]:
    """For each batch, the fewest equal values so far that keep P(similarity >= threshold) at ``miss`` or more.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose upper tail at t is the
    probability of at most m successes in n + 1 trials."""
    t, out = percent / 100, []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def prune(pairs: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b) of the pairs (a, b, sig_a, sig_b) that the sequential test leaves."""
    needed = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SIGNATURE) for i in (2, 3)]
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, least in enumerate(needed):
                at = slice(i * BATCH, (i + 1) * BATCH)
                matches[alive] += (left[alive, at] == right[alive, at]).sum(1)
                alive = alive[matches[alive] >= least]
            yield batch.select([0, 1]).take(pa.array(alive))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def overlaps(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, both, either) of the pairs (a, b, packed_a, packed_b): sizes of intersection and union of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                found = []
                for a, b in zip(part.column(2), part.column(3)):
                    texts = [_unpacked(a.as_py()), _unpacked(b.as_py())]
                    data = np.frombuffer(b"".join(texts), np.uint8)
                    row, shingle = shingle_sets(data, np.array([0, len(texts[0]), len(data)]), k)
                    n = int((row == 0).sum())
                    both = len(np.intersect1d(shingle[:n], shingle[n:], assume_unique=True))
                    found.append((both, len(shingle) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[
                    pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]], names=["a", "b", "both", "either"])

    return pairs.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a long, b long, both long, either long")


def link_classes(classes: DataFrame, docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """(a, b) links that join every component of the classes (doc_id, n_shingles, bands, signature)."""
    every = classes.select(F.explode("bands").alias("key"), "doc_id")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = materialise(every.join(shared, "key"))
    popular = buckets.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    facts = materialise(classes.select("doc_id", "n_shingles", "signature").join(popular, "doc_id"))
    # Texts are dealt by id at every size and met by a hash of the few ids, so they are neither sorted nor is a set of
    # ids that grows with the corpus broadcast.
    texts = materialise(packed_texts(docs).join(facts.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi"))
    body = lambda c: texts.select(F.col("doc_id").alias(c), F.col("packed").alias(f"packed_{c}"))
    exact = lambda pairs: overlaps(pairs.join(body("a"), "a").join(body("b"), "b"), k)
    linked = f"both > 0 and 100 * both >= {percent} * either"

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: facts.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"sig_{c}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(
            F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        return materialise(exact(prune(sized, percent, miss)))

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # Every member against the centre of its bucket: the one that shares the most bucket places overall.
    centres = buckets.join(facts.select("doc_id", "weight"), "doc_id").groupBy("key").agg(
        F.max(F.struct("weight", -F.col("doc_id"), "doc_id"))["doc_id"].alias("centre"))
    starred = materialise(buckets.join(centres, "key").select("key", "doc_id", "centre"))
    first = verified(starred.filter("doc_id <> centre").select(*pair("doc_id", "centre")).distinct())
    links = first.filter(linked).select("a", "b")
    labels = materialise(connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("label")))
    placed = starred.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    apart = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"),
                                      F.max(F.when(F.col("doc_id") == F.col("centre"), F.col("label"))).alias("home"))
    # Two members have met already; of the rest, a pair in different components has one end away from the centre's.
    rows = materialise(placed.filter("doc_id <> centre").join(
        apart.filter("lo < hi and n > 2").select("key", "home"), "key").select("centre", "doc_id", "label", "home").distinct())
    stars = rows.select(*pair("doc_id", "centre")).distinct()
    known = first.select("a", "b", "both", "either")
    rest = materialise(exact(stars.join(known, ["a", "b"], "left_anti")))
    far = known.unionAll(rest).select("a", "b", (1 - F.col("both") / F.greatest("either", F.lit(1))).alias("far"))
    spread = materialise(rows.withColumns(dict(zip("ab", pair("doc_id", "centre")))).join(far, ["a", "b"]).select(
        "centre", "doc_id", "label", "far", (F.col("label") != F.col("home")).alias("away")).groupBy(
        "centre", "doc_id", "label", "far").agg(F.max("away").alias("away")))
    # A member lives in one block of its centre; members away from the centre's component also visit the other blocks.
    sizes = spread.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    member = spread.join(sizes, "centre").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    home = materialise(member.join(facts.select("doc_id", "n_shingles", "signature"), "doc_id"))
    columns = ["centre", "block", "resident", "doc_id", "label", "far", "away", "n_shingles", "signature"]
    residents = home.withColumns({"block": F.col("mine"), "resident": F.lit(True)}).select(columns)
    visits = home.filter("away").withColumns({
        "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "resident": F.lit(False)}).select(columns)
    # First by signature: who has a partner in which block.  Then only these bring their texts, to those blocks.
    place = ["centre", "block"]
    met = materialise(block_guests(residents.unionAll(visits), percent, miss))
    here = residents.join(met.select(*place).distinct(), place, "left_semi").unionByName(
        visits.join(met, [*place, "doc_id"], "left_semi"))
    return links.unionAll(block_links(here.join(texts, "doc_id").select(*columns, "packed"), k, percent, miss))


class Members:
    """Columns of members of one block, by number: id, label, distance to the centre, away, size, signature, text."""

    def __init__(self, part: pa.RecordBatch):
        self.columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(3, 8)]
        self.columns.append(np.frombuffer(b"".join(part.column(8).to_pylist()), "<u2").reshape(-1, SIGNATURE))
        if part.num_columns > 9:
            self.columns.append(np.array(part.column(9).to_pylist(), object))

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, other: "Members") -> None:
        self.columns = [np.concatenate(x) for x in zip(self.columns, other.columns)]


def likely(home: Members, guests: Members, percent: int, needed: list[int], reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of guests and residents that may be linked though they are apart: their components differ, their sizes
    allow a link, their distances to the centre differ by no more than a link can bridge (Jaccard distance is a metric),
    and the sequential test passes.  Two members that are both away meet where the larger id lives."""
    ids, label, far, away, size, signature = home.columns[:6]
    g_ids, g_label, g_far, _, g_size, g_signature = guests.columns[:6]
    fits = (g_label[:, None] != label) & (np.abs(g_far[:, None] - far) <= reach) & (~away | (g_ids[:, None] < ids)) & (
        np.minimum(g_size[:, None], size) * 100 >= np.maximum(g_size[:, None], size) * percent)
    x, y = np.nonzero(fits)
    matches = np.zeros(len(x), np.int64)
    for step, least in enumerate(needed):
        at = slice(step * BATCH, (step + 1) * BATCH)
        matches += (g_signature[x, at] == signature[y, at]).sum(1)
        alive = matches >= least
        x, y, matches = x[alive], y[alive], matches[alive]
    return x, y


def _by_block(dealt: DataFrame, visit, schema: str) -> DataFrame:
    """``visit(place, residents, guests)`` for slices of the guests of each block; a task holds one block's residents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, home, state = None, None, None
        for batch in batches:
            centre, block, resident = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)]
            turn = np.flatnonzero(np.concatenate([[True], (np.diff(centre) != 0) | (np.diff(block) != 0) | (resident[1:] != resident[:-1])]))
            for begin, end in zip(turn.tolist(), [*turn[1:].tolist(), batch.num_rows]):
                if place != (centre[begin], block[begin]):
                    place, home, state = (centre[begin], block[begin]), None, {}
                if resident[begin]:  # residents come first
                    part = Members(batch.slice(begin, end - begin))
                    home = part if home is None else (home.add(part) or home)
                elif home is not None:
                    for at in range(begin, end, 256):
                        yield visit(place, home, Members(batch.slice(at, min(256, end - at))), state)

    key = ["centre", "block"]
    return dealt.repartition(*key).sortWithinPartitions(*key, F.desc("resident")).mapInArrow(run, schema)


def block_guests(dealt: DataFrame, percent: int, miss: float) -> DataFrame:
    """(centre, block, doc_id) of the guests with a likely partner in the block: ids and signatures only."""
    needed, reach = least_matches(percent, miss), 1 - percent / 100 + 1e-9

    def visit(place, home: Members, guests: Members, _) -> pa.RecordBatch:
        found = guests.columns[0][np.unique(likely(home, guests, percent, needed, reach)[0])]
        return pa.RecordBatch.from_arrays([*[pa.array(np.full(len(found), p), t) for p, t in zip(place, (pa.int64(), pa.int32()))], pa.array(
            found, pa.int64())], names=["centre", "block", "doc_id"])

    return _by_block(dealt, visit, "centre long, block int, doc_id long")


def block_links(dealt: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """(a, b) links between guests and residents, decided on their full sets.  Pairs that links of this block have joined
    already are settled, so a block gives no more links than it has members."""
    needed, reach = least_matches(percent, miss), 1 - percent / 100 + 1e-9

    def shingles(packed: bytes) -> np.ndarray:
        data = np.frombuffer(_unpacked(packed), np.uint8)
        return shingle_sets(data, np.array([0, len(data)]), k)[1]

    def visit(place, home: Members, guests: Members, state: dict) -> pa.RecordBatch:
        parent, sets = state.setdefault("parent", {}), state.setdefault("sets", {})

        def root(label: int) -> int:
            while parent.get(label, label) != label:
                label = parent[label]
            return label

        out, current, mine = [], -1, None
        x, y = likely(home, guests, percent, needed, reach)
        for i, j in zip(x.tolist(), y.tolist()):
            one, two = root(int(guests.columns[1][i])), root(int(home.columns[1][j]))
            if one == two:
                continue
            if i != current:
                current, mine = i, shingles(guests.columns[6][i])
            if j not in sets:
                if sum(map(len, sets.values())) > KEPT:
                    sets.clear()
                sets[j] = shingles(home.columns[6][j])
            other = sets[j]
            both = len(np.intersect1d(mine, other, assume_unique=True))
            if both and 100 * both >= percent * (len(mine) + len(other) - both):
                parent[max(one, two)] = min(one, two)
                out.append((int(guests.columns[0][i]), int(home.columns[0][j])))
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return _by_block(dealt, visit, "a long, b long")


def near_duplicates(docs: DataFrame, k=5, percent=80, miss=1e-6, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: n_shingles, component_id (least id reachable by links) and kept."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialise(signatures(docs, k))
    sets = signed.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id"))
    classes = signed.join(sets.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    labels = connected_components(link_classes(classes, docs, k, percent, miss)).select(
        F.col("node").alias("class_id"), F.col("component").alias("label"))
    member = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(sets, ["set_a", "set_b"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    out = member.join(labels, "class_id", "left").withColumn("component_id", F.coalesce("label", "class_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_per_group(docs: DataFrame, doc_id="doc_id", **options) -> DataFrame:
    """``docs`` with the document of least id of each group."""
    kept = near_duplicates(docs, doc_id=doc_id, **options).filter("kept").select(F.col("doc_id").alias(doc_id))
    return docs.join(kept.hint("shuffle_hash"), doc_id, "left_semi")
