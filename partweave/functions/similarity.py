"""String, set, vector and price similarity."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..masters import DEFAULT_CONFIG, EngineConfig
from .expr import clamp01, let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """V3 - 0 for empty vectors, unequal lengths or zero norms."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(usable & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def calibrate(cos: Column, config: EngineConfig = DEFAULT_CONFIG) -> Column:
    """V4"""
    return clamp01((cos - config.cosine_floor) / (config.cosine_ceil - config.cosine_floor))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """V5"""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def token_jaccard(a: Column, b: Column) -> Column:
    """V8 - 1 when both token lists are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _jaro_winkler_block(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of many pairs at once; a, b are zero-padded character matrices, la, lb their lengths.

    The loop runs over character positions of ``a``; each step matches one position of every pair of the batch."""
    n, wa = a.shape
    wb = b.shape[1]
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    cols = np.arange(wb)[None, :]
    taken = np.zeros((n, wb), bool)
    a_hit = np.zeros((n, wa), bool)
    for i in range(wa):
        live = np.nonzero(i < la)[0]
        if not len(live):
            break
        ok = (b[live] == a[live, i][:, None]) & ~taken[live]
        ok &= (cols >= (i - reach[live])[:, None]) & (cols < np.minimum(i + reach[live] + 1, lb[live])[:, None])
        at = ok.argmax(axis=1)
        hit = ok[np.arange(len(live)), at]
        a_hit[live[hit], i] = True
        taken[live[hit], at[hit]] = True
    m = a_hit.sum(axis=1)
    # k-th matched character on each side, aligned by rank
    transposed = np.zeros(n)
    rows = np.nonzero(m)[0]
    if len(rows):
        ra, ca = np.nonzero(a_hit[rows])
        rb, cb = np.nonzero(taken[rows])
        differ = a[rows][ra, ca] != b[rows][rb, cb]
        transposed[rows] = np.bincount(ra, weights=differ, minlength=len(rows))
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / la + m / lb + (m - transposed / 2) / m) / 3
    prefix = np.zeros(n)
    same = np.ones(n, bool)
    for i in range(min(4, wa, wb)):
        same &= (i < la) & (i < lb) & (a[:, i] == b[:, i])
        prefix += same
    out = np.where(m > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)
    return out


def jaro_winkler_arrays(left: list[str], right: list[str]) -> np.ndarray:
    """Vectorised over a batch: pairs are bucketed by length so padding stays small."""
    out = np.zeros(len(left))
    todo = []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
        elif x and y:
            todo.append(i)
    todo.sort(key=lambda i: (len(left[i]), len(right[i])))
    start = 0
    while start < len(todo):
        width = max(len(left[todo[start]]), 16)
        stop = start
        while stop < len(todo) and len(left[todo[stop]]) <= width * 1.25 and stop - start < max(1, 4_000_000 // (
                width * 8)):
            stop += 1
        idx = todo[start:stop]
        la = np.array([len(left[i]) for i in idx])
        lb = np.array([len(right[i]) for i in idx])
        a = np.zeros((len(idx), la.max()), np.uint32)
        b = np.zeros((len(idx), lb.max()), np.uint32)
        for r, i in enumerate(idx):
            a[r, :la[r]] = np.frombuffer(left[i].encode("utf-32-le"), np.uint32)
            b[r, :lb[r]] = np.frombuffer(right[i].encode("utf-32-le"), np.uint32)
        out[idx] = _jaro_winkler_block(a, la, b, lb)
        start = stop
    return out


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """V6 - prefix boost always applied, half transpositions kept; NULL in, NULL out."""
    null = a.isna() | b.isna()
    out = pd.Series(jaro_winkler_arrays(a.fillna("").tolist(), b.fillna("").tolist()))
    return out.mask(null.reset_index(drop=True))


def sorted_tokens(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def sorted_token_jw(a: Column, b: Column) -> Column:
    """V7"""
    return jaro_winkler(sorted_tokens(a), sorted_tokens(b))


def fuse_semantic(cos: Column, sorted_jw: Column, lev: Column, jac: Column, raw_jw: Column,
                  config: EngineConfig = DEFAULT_CONFIG) -> Column:
    """V9"""
    fuzzy = 0.5 * sorted_jw + 0.25 * lev + 0.25 * jac
    return clamp01(0.65 * calibrate(cos, config) + 0.35 * F.greatest(fuzzy, raw_jw * 0.9))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """V10 - shared trigrams over all trigrams."""
    return let(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")), lambda t: F.coalesce(F.try_divide(
        F.size(F.array_intersect(t["a"], t["b"])).cast("double"), F.size(F.array_union(t["a"], t["b"]))), F.lit(0.0)))


def price_similarity(a: Column, b: Column) -> Column:
    """V11 - NULL when a price is missing or zero."""
    return F.when((a != 0) & (b != 0), clamp01(1 - F.abs(F.log(a / b)) / float(np.log(2.5))))


def class_similarity(category_a: Column, category_b: Column, subtype_a: Column, subtype_b: Column) -> Column:
    """V12"""
    return (F.when(category_a != category_b, 0.0)
            .when(subtype_a.isNull() | subtype_b.isNull(), 0.8)
            .when(subtype_a == subtype_b, 1.0).otherwise(0.4))
