"""Set-similarity join by prefixes, positions and sizes (V10, K7): Jaccard at ``threshold`` or more.

All elements are put in one order, rare ones of the indexed side first.  If two sets of sizes q and n reach the threshold,
they share one of the first ``q - ceil(t * q) + 1`` elements of the one and ``n - ceil(t * n) + 1`` of the other, so only
these prefixes are indexed and looked up, and the most common elements of a set are in none.  A meeting at positions i
and j is a candidate only if sizes fit (``t * n <= q``, ``t * q <= n``) and the elements left behind i and j can still make
up the overlap ``t / (1 + t) * (q + n)``.  Candidates are then verified on their whole sets.

Null and empty sets match nothing; an element is counted once in a set; ids must be unique on their side."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes are whole numbers; this keeps a product like 0.3 * 10 from landing above the whole number it is.
EPS = 1e-9


@dataclass
class SetIndex:
    """``order`` (element, df), ``prefixes`` (element, id, n, at) and ``sets`` (id, elements) of the indexed side."""
    order: DataFrame
    prefixes: DataFrame
    sets: DataFrame
    threshold: float


def _ordered(sets: DataFrame, order: DataFrame) -> DataFrame:
    """(id, elements): elements of each set in the common order; those the index does not know come first."""
    flat = sets.select("id", F.explode(F.array_distinct("elements")).alias("element")).filter("element is not null")
    placed = flat.join(order, "element", "left").select("id", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "element").alias("e"))
    return placed.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("e")).select(  # a set is bounded by its row
        "id", F.col("e.element").alias("elements"))


def _prefix(ordered: DataFrame, threshold: float) -> DataFrame:
    n = F.size("elements")
    length = n - F.ceil(n * threshold - EPS).cast("int") + 1
    return ordered.select("id", n.alias("n"), F.posexplode(F.slice("elements", F.lit(1), F.least(length, n))).alias("at", "element"))


def set_index(sets: DataFrame, threshold: float) -> SetIndex:
    """Index ``sets`` (id, elements).  Write its parts as tables to serve lookups without the sets' texts."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    order = sets.select(F.explode(F.array_distinct("elements")).alias("element")).filter("element is not null").groupBy(
        "element").agg(F.count(F.lit(1)).alias("df"))
    ordered = _ordered(sets, order)
    return SetIndex(order, _prefix(ordered, threshold), ordered, threshold)


def _can_reach(t: float, q: Column, i: Column, n: Column, j: Column) -> Column:
    """Sizes fit, and one shared element plus all behind positions i and j are enough.

    An earlier shared element would have met at its own positions, so the first one of the order decides."""
    left = F.least(q - i, n - j)
    return (n >= q * t - EPS) & (q >= n * t - EPS) & (left * (1 + t) >= (q + n) * t - EPS)


def candidates(requests: DataFrame, index: SetIndex) -> DataFrame:
    """(request_id, id): pairs that meet in a prefix at positions that leave enough behind them."""
    q = _prefix(_ordered(requests, index.order), index.threshold).select(
        F.col("id").alias("request_id"), F.col("n").alias("q"), F.col("at").alias("i"), "element")
    fits = _can_reach(index.threshold, F.col("q"), F.col("i"), F.col("n"), F.col("at"))
    return q.join(index.prefixes, "element").filter(fits).select("request_id", "id").distinct()


def similar_sets(requests: DataFrame, index: SetIndex) -> DataFrame:
    """(request_id, id, sim) of requests (id, elements) and indexed sets with sim >= threshold."""
    asked = requests.select(F.col("id").alias("request_id"), F.filter(F.array_distinct("elements"), lambda e: e.isNotNull()).alias("asked"))
    met = candidates(requests, index).join(asked, "request_id").join(index.sets, "id")
    shared = F.size(F.array_intersect("asked", "elements"))
    return met.select("request_id", "id", (shared / (F.size("asked") + F.size("elements") - shared)).alias("sim")).filter(
        F.col("sim") >= index.threshold)
