"""Places where a model service plugs in, with deterministic offline defaults."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexmill.functions.text import tokens

#: Vectors of texts, all of one length.
Embedder = Callable[[Sequence[Sequence[str]]], np.ndarray]


def hashed_words(size: int = 128) -> Embedder:
    """Offline embedder: signed feature hashing of words and neighbouring pairs, to length 1."""

    def embed(texts: Sequence[Sequence[str]]) -> np.ndarray:
        # Each distinct word and pair is hashed once; signs add up to whole numbers, in any order the same.
        lengths = np.array([len(words) for words in texts], dtype=int)
        rows = np.repeat(np.arange(len(texts)), lengths)
        codes, known = pd.factorize(np.array(list(chain.from_iterable(texts)), dtype=object))
        near = np.flatnonzero(rows[1:] == rows[:-1])
        pairs, at = np.unique(codes[near] * max(len(known), 1) + codes[near + 1], return_inverse=True)
        firsts, seconds = (known[x] for x in np.divmod(pairs, max(len(known), 1)))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in chain(known, map(" ".join, zip(firsts, seconds)))], dtype=np.uint64)
        of = hashes[np.concatenate([codes, at + len(known)])]
        signs = np.where(of >> np.uint64(63), 1.0, -1.0)
        out = np.bincount(np.concatenate([rows, rows[near]]) * size + (of % np.uint64(size)).astype(int), signs, len(texts) * size).reshape(len(texts), size).astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    return embed


def embedded(col: Column | str, embedder: Embedder | None = None) -> Column:
    """Vector of each text's words by an embedder, made in Arrow batches; a text without words has a zero vector."""
    model = embedder or hashed_words()

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(words: pd.Series) -> pd.Series:
        return pd.Series(list(model([w.tolist() for w in words])), dtype=object)

    return embed(tokens(col))
