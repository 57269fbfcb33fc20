"""Word pieces by greedy longest match and a mean-pooled embedding over any table of piece vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

CLS, SEP, UNKNOWN = "[CLS]", "[SEP]", "[UNK]"


def pieces(word: str, vocabulary: dict[str, int], longest: int, most: int) -> list[int]:
    """Ids of a lower-case word's pieces: the whole word, or from the left the longest piece the vocabulary has; others are unknown."""
    if word in vocabulary:
        return [vocabulary[word]]
    out, at = [], 0
    while at < len(word) and len(out) < most:
        fits = (n for n in range(min(longest, len(word) - at), 0, -1) if word[at : at + n] in vocabulary)
        n = next(fits, 0)
        name = ("##" if at else "") + word[at : at + n]
        out.append(vocabulary.get(name, vocabulary[UNKNOWN]) if n else vocabulary[UNKNOWN])
        at += max(n, 1)
    return out


def tokenise(text: str, vocabulary: dict[str, int], most: int = 128) -> list[int]:
    """Ids of a text between its two marks, most of them at most; a blank text is one unknown word."""
    longest = max(map(len, vocabulary))
    out = [vocabulary[CLS]]
    for w in text.lower().split() or ["[unk]"]:
        if (room := most - 1 - len(out)) <= 0:
            break
        out += pieces(w, vocabulary, longest, room)
    return [*out, vocabulary[SEP]]


def embedder(vocabulary: dict[str, int], vectors: np.ndarray, most: int = 128):
    """A pandas UDF: the mean of a text's piece vectors (a row for each id; any model's table), length 1."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            v = vectors[tokenise(t or "", vocabulary, most)].mean(0)
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32)

        return texts.map(one)

    return embed
