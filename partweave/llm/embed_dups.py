"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its ``nearest`` closest reference points (pivots), in order.  Inverted lists are kept for
every two pivots that a vector names among them, so a list's members share a pivot count of two or more; lists are
read inside one label.  Members are compared exactly, in double precision, and a pair that shares more than two pivots
is counted only in the list of its two first shared pivots.

Equal vectors are one class with a weight.  A list longer than ``block`` is dealt into blocks and compared as pairs of
blocks in tasks of their own.  A list yields one count for each member and links that span its components, never its
pairs.  Fitted on a sample: the pivots are ``pivots`` vectors of each dimension, those of least hash of their id; every
vector is indexed by the pivots of its dimension.

Defined results: vectors that are null, empty or zero, or that hold null or non-finite components, and vectors whose
label is null, are linked with nothing; vectors of different dimensions are never linked; repeated rows with ids of
their own are linked; links at exactly the threshold count; ids must be unique; extra columns are not read; an empty table gives
an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import materialise


def usable_vectors(rows: DataFrame, vec_id="vec_id", vector="embedding", label="label") -> DataFrame:
    """(label, vector, vec_id, weight): classes of equal usable vectors, named by their least id.

    ``label`` holds the dimension too, as vectors of different ones are never compared."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
        .select(_sized_label(label, vector), v.alias("vector"), F.col(vec_id).cast("long").alias("vec_id"))
        .filter(finite & F.exists("vector", lambda x: x != 0.0))
        .groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    )


def _sized_label(label: str, vector: str):
    return F.concat_ws(":", F.size(F.col(vector)).cast("string"), F.col(label).cast("string")).alias("label")


def choose_pivots(classes: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """For each dimension ``pivots`` unit vectors at most; the driver holds nothing else.  The limit in each dimension is
    taken in every partition before rows move."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    rows = classes.select(F.size("vector").alias("dim"), "vector", "vec_id").withColumn(
        "nth", F.row_number().over(order)).filter(F.col("nth") <= pivots).orderBy("dim", "nth").collect()
    return {d: _unit(np.array([r["vector"] for r in rows if r["dim"] == d])) for d in sorted({r["dim"] for r in rows})}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def described(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """Add ``pivots``: the nearest pivots of the vector's dimension in order of closeness, ties by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            parts = ((dim, same.slice(begin, 4096)) for dim in np.unique(sizes).tolist()
                     for same in [batch.filter(pa.array(sizes == dim))] for begin in range(0, same.num_rows, 4096))
            for dim, part in parts:
                x = part.column(1).flatten().to_numpy().reshape(-1, dim)
                near = np.argsort(-(_unit(x) @ pivots[dim].T), axis=1, kind="stable")[:, :nearest].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(near), pa.list_(pa.int32()))],
                    names=["label", "vector", "vec_id", "weight", "pivots"])

    return classes.select("label", "vector", "vec_id", "weight").mapInArrow(
        run, "label string, vector array<double>, vec_id long, weight long, pivots array<int>")


def inverted_lists(index: DataFrame, block: int) -> DataFrame:
    """Entries of the lists with two members or more, dealt to block pairs (i, j); ``mine`` is the entry's block."""
    names = F.expr("flatten(transform(array_sort(pivots), x -> transform(filter(pivots, y -> y > x), y -> struct(x as p, y as q))))")
    entries = index.select("label", F.explode(names).alias("k"), "vec_id", "weight", "pivots", "vector").select(
        "label", "k.p", "k.q", "vec_id", "weight", "pivots", "vector")
    lengths = index.select("label", F.explode(names).alias("k")).groupBy("label", "k.p", "k.q").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    mine = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    return entries.join(lengths, ["label", "p", "q"]).withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "p", "q", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine",
        "vec_id", "weight", "pivots", "vector")


def compare_list(p: int, q: int, i: int, j: int, mine: np.ndarray, weight: np.ndarray, pivots: np.ndarray, x: np.ndarray,
                 threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link count of each entry and the first entry of its component, for one pair of blocks."""
    unit = _unit(x)
    linked = unit @ unit.T >= threshold
    # The list owns a pair if p and q are its two smallest shared pivots: none below q is shared but p.
    below = np.where(pivots < q, pivots, -1)
    width = max(q, 1)
    named = np.zeros((len(x), width), np.float32)
    rows = np.repeat(np.arange(len(x)), pivots.shape[1])[below.ravel() >= 0]
    named[rows, below.ravel()[below.ravel() >= 0]] = 1
    linked &= (named @ named.T) == 1
    if i != j:
        linked &= mine[:, None] != mine[None, :]
    np.fill_diagonal(linked, False)
    counts = linked @ weight
    first = np.arange(len(x))
    while True:
        reach = np.where(linked, first[None, :], len(x)).min(1, initial=len(x))
        new = np.minimum(first, reach)
        new = new[new]
        if (new == first).all():
            return counts, first
        first = new


def compared(lists: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, links, to): per list and entry with a link, its weighted count and an entry of its component."""

    def close(group, rows):
        label, p, q, i, j = group
        mine, ids, weight = [np.array([r[c] for r in rows], np.int64) for c in (0, 1, 2)]
        counts, first = compare_list(p, q, i, j, mine, weight, np.stack([r[3] for r in rows]),
                                     np.stack([r[4] for r in rows]), threshold)
        some = np.flatnonzero(counts)
        return ids[some], counts[some], ids[first[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], []

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[c] for o in out]), pa.int64()) for c in range(3)], names=["vec_id", "links", "to"])
            out.clear()
            return batch

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(5)]))
            values = list(zip(*[batch.column(c).to_pylist() for c in (5, 6, 7)],
                              [r.values.to_numpy() for r in batch.column(8)], [r.values.to_numpy() for r in batch.column(9)]))
            for key, value in zip(keys, values):
                if key != group:
                    if len(rows) > 1:
                        out.append(close(group, rows))
                    group, rows = key, []
                rows.append(value)
            if len(out) > 1000:
                yield flush()
        if len(rows) > 1:
            out.append(close(group, rows))
        if out:
            yield flush()

    key = ["label", "p", "q", "i", "j"]
    return lists.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "vec_id long, links long, to long")


def near_duplicate_vectors(rows: DataFrame, threshold=0.93, pivots=256, nearest=7, block=512, vec_id="vec_id",
                           vector="embedding", label="label") -> DataFrame:
    """One row per vector: n_links, component_id (least id reachable by links) and kept."""
    classes = materialise(usable_vectors(rows, vec_id, vector, label))
    every = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.col(label).isNotNull(), _sized_label(label, vector)).alias("label"),
                        F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector"))
    points = choose_pivots(classes, pivots)
    if not len(points):
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.lit(True).alias("kept"))
    index = materialise(described(classes, points, nearest))
    found = materialise(compared(inverted_lists(index, block), threshold))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("vec_id").alias("a"), F.col("to").alias("b"))).select(
        F.col("node").alias("vec_id"), "component")
    per_class = index.select("label", "vector", "vec_id", "weight").join(links, "vec_id", "left").join(
        groups, "vec_id", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return every.join(per_class, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))
