"""Sizes of texts in tokens of a public byte-level BPE vocabulary (a rank file, given by path)."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"


def default_ranks() -> str:
    """Path of the default rank file in the box's collection of public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_RANKS)


def default_pattern() -> str:
    """Pattern that cuts texts for the box's vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str | None = None):
    """One encoding per process, rank file and pattern."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern or default_pattern(), mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Number of tokens of the whole text; 0 for a null or empty one.

    ``path``: a rank file that every executor can read; ``pattern``: how its vocabulary cuts texts.
    """
    path = path or default_ranks()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path, pattern)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
