"""Hashes that no built-in function has; Arrow batches go through one worker a task."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .columns import ascii_tokens


def blake2b_bucket(token: str, dim: int) -> int:
    """Bucket of a token: its 8-byte BLAKE2b, little-endian, modulo ``dim``."""
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % dim


def hashed_counts(text: Column, dim: int) -> Column:
    """Token counts of a text in ``dim`` buckets, as an array of floats; null is empty.

    Each row is done within itself, so nothing is exploded or shuffled.
    """

    @pandas_udf("array<float>")
    def counts(tokens: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for row in tokens:
            sums = [0.0] * dim
            for t in row:
                if (b := known.get(t)) is None:
                    if len(known) >= 200_000:  # a cache; the results do not depend on it
                        known.clear()
                    b = known[t] = blake2b_bucket(t, dim)
                sums[b] += 1.0
            out.append(sums)
        return pd.Series(out)

    return counts(ascii_tokens(F.coalesce(text, F.lit(""))))
