"""Vector functions as Column expressions, and a hashing embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, zero or unequally long vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(F.coalesce(dot(a, b) / norm, F.lit(0.0)))


def unit(v: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def hash_embed(dim: int = 64):
    """A pandas UDF: byte i of the text is added to dimension i mod dim; length 1."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            b = np.frombuffer((t or "").encode(), np.uint8).astype(np.float64)
            v = np.bincount(np.arange(len(b)) % dim, weights=b, minlength=dim)
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32)

        return texts.map(one)

    return embed
