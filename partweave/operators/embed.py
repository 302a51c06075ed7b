"""Hashed n-gram embedding (V2) of semantic tokens."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import semantic_tokens

DIM = 256


def _fnv1a(text: str) -> int:
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ (units[i] | units[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return h


def _signed_bucket(feature: str) -> tuple[int, float]:
    h = _fnv1a(feature)
    return h % DIM, 1.0 if (h >> 16) & 1 else -1.0


def _word_features(word: str) -> tuple[np.ndarray, np.ndarray]:
    padded = f"^{word}$"
    grams = max(1, len(padded) - 2)
    feats = [("w:" + word, 1.3 if any(c in "0123456789" for c in word) else 1.0)]
    feats += [("c:" + padded[i:i + 3], 0.45 / np.sqrt(grams)) for i in range(len(padded) - 2)]
    slots = [(_signed_bucket(f), w) for f, w in feats]
    return np.array([s[0] for s, _ in slots]), np.array([s[1] * w for s, w in slots])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed_tokens(tokens: pd.Series) -> pd.Series:
    """Arrow batch in, unit vectors out.  Word and bigram slots are computed once per batch vocabulary."""
    words: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    pairs: dict[tuple[str, str], tuple[int, float]] = {}
    out = []
    for row in tokens:
        vec = np.zeros(DIM)
        row = [] if row is None else list(row)
        for w in dict.fromkeys(row):
            if w not in words:
                words[w] = _word_features(w)
            np.add.at(vec, *words[w])
        for pair in zip(row, row[1:]):
            if pair not in pairs:
                pairs[pair] = _signed_bucket(f"b:{pair[0]}_{pair[1]}")
            slot, sign = pairs[pair]
            vec[slot] += sign * 0.35
        norm = float(np.sqrt((vec * vec).sum())) or 1.0
        out.append(np.floor(vec / norm * 1e6 + 0.5) / 1e6)
    return pd.Series(out)


def with_embedding(records: DataFrame, text_col: str = "normalized", out: str = "embedding") -> DataFrame:
    return records.withColumn(out, embed_tokens(semantic_tokens(F.col(text_col))))


def fnv1a32(c: Column) -> Column:
    """V1 - FNV-1a over character codes (ASCII text), as a JVM-side fold."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: F.length(x) > 0), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("bigint"), lambda h, x: (
        (h.bitwiseXOR(x)) * F.lit(0x01000193).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
