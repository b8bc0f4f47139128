"""Distances that need Python: compression, longest common subsequence."""

from __future__ import annotations

import zlib
from typing import Protocol

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class Compressor(Protocol):
    """E01."""

    def size(self, data: bytes) -> int: ...


class Zlib:
    def __init__(self, level: int = 6):
        self.level = level

    def size(self, data: bytes) -> int:
        return len(zlib.compress(data, self.level)) if data else 0


class Zstd:
    def __init__(self, level: int = 3):
        self.level = level

    def size(self, data: bytes) -> int:
        import zstandard

        return len(zstandard.ZstdCompressor(level=self.level).compress(data)) if data else 0


def qnd_value(compressor: Compressor, prompt: str, content: str) -> float:
    """what the prompt adds to the compressed content, as a share of its own size; 1 for an empty prompt."""
    p, c = (prompt or "").encode(), (content or "").encode()
    own = compressor.size(p)
    return 1.0 if not own else (compressor.size(c + b"\n" + p) - compressor.size(c)) / own


def qnd(compressor: Compressor | None = None):
    """A pandas UDF (prompt, content) -> double."""
    made = compressor or Zlib()

    @F.pandas_udf(DoubleType())
    def run(prompt: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([qnd_value(made, p, c) for p, c in zip(prompt, content)])

    return run


def lcs_length(a: list, b: list) -> int:
    """F06, bit-parallel: a row of the table is one number, whose zero bits are where the length grows."""
    if len(a) < len(b):
        a, b = b, a
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & at.get(x, 0)
        if met:
            row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of the first list's length."""
    return pd.Series([lcs_length(list(x), list(y)) / len(x) if len(x) else 0.0 for x, y in zip(a, b)])
