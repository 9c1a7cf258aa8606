"""Vectors for labels where no pretrained table is at hand: signed token hashes, averaged."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import join_labels

SIZE = 300


@lru_cache(200_000)
def _token(word: str, size: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    return np.random.default_rng(seed).standard_normal(size).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    """The mean of the tokens' vectors; zeros without a token. The text isn't normalised."""
    return texts.map(lambda t: np.mean([_token(w, SIZE) for w in (t or "").split()] or [np.zeros(SIZE, np.float32)], axis=0))


def embeddings(labels: DataFrame) -> DataFrame:
    """(concept, embedding) of labels(concept, labels)."""
    return labels.select("concept", embed(join_labels(F.col("labels"))).alias("embedding"))
