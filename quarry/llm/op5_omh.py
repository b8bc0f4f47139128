"""Order MinHash fingerprints.

The K-byte pieces of a text's UTF-8 are numbered by occurrence, so that repeats
differ.  For each of SLOTS permutations the PICKS least of them are taken, put
back in text order, and hashed as a tuple: two texts agree in a slot only if they
share its pieces and have them in one order, which is what edit distance asks.
Likeness is the share of equal slots.

Permutation j ranks a piece with hash x by (a_j * x + b_j) mod 2^32, a_j odd.

Cases: text null counts as empty; texts under K bytes are one piece, the empty
text too; equal texts have equal fingerprints; rows that share a doc_id are taken
in order of their text; doc_id null comes before every number; a table of one row
is its own successor; repeated rows stay; further columns are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table, text_slices
from .ordered import with_tails
from .words import mix

K, SLOTS, PICKS = 8, 64, 2
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
#: Pieces that one step ranks under all permutations.
_STEP = 1 << 15
_TOP = np.uint32(0xFFFFFFFF)


def pieces(data: bytes) -> np.ndarray:
    """A 32-bit hash of each occurrence-numbered piece, in text order."""
    if len(data) < K:
        return mix(np.array([int.from_bytes(data, "little") << 4 | len(data)], np.uint64)).astype(np.uint32)
    raw = np.ndarray(len(data) - K + 1, "<u8", data, 0, (1,))
    x = mix(np.ascontiguousarray(raw))
    n = len(x)
    bits = max(1, int(n - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    keyed = (x & ~low) | np.arange(n, dtype=np.uint64)  # one sort gives equal pieces in text order
    keyed.sort()
    same = np.zeros(n, bool)
    np.equal(keyed[1:] >> np.uint64(bits), keyed[:-1] >> np.uint64(bits), out=same[1:])
    if same.any():
        at = np.arange(n)
        nth = at - np.maximum.accumulate(np.where(same, 0, at))
        again = np.flatnonzero(same)
        spot = (keyed[again] & low).astype(np.int64)
        x[spot] = mix(x[spot] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(32)).astype(np.uint32)


def signature(data: bytes) -> np.ndarray:
    """SLOTS hashes of ordered tuples."""
    x = pieces(data)
    best = np.full((SLOTS, PICKS), _TOP, np.uint32)
    where = np.full((SLOTS, PICKS), len(x), np.int64)
    rows = np.arange(SLOTS)
    for begin in range(0, len(x), _STEP):
        ranks = _A[:, None] * x[None, begin : begin + _STEP] + _B[:, None]
        for _ in range(min(PICKS, ranks.shape[1])):
            at = ranks.argmin(1)
            value = ranks[rows, at]
            better = value < best[:, -1]
            if not better.any():
                break
            best[better, -1], where[better, -1] = value[better], at[better] + begin
            order = np.argsort(best, 1, kind="stable")
            best, where = np.take_along_axis(best, order, 1), np.take_along_axis(where, order, 1)
            ranks[rows, at] = _TOP
    where.sort(1)
    out = np.full(SLOTS, len(_A), np.uint64)
    padded = np.append(x, np.uint32(0)).astype(np.uint64)
    for p in range(PICKS):
        out = mix(out * np.uint64(0x100000001B3) + padded[where[:, p]] + (where[:, p] == len(x)).astype(np.uint64) * np.uint64(1 << 40))
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, gives way to as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def text_of(signed: np.ndarray) -> str:
    return signed.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of whole texts: a map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(signature((t or "").encode())) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def against_next(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside its edited text's and the next document's, by ascending doc_id."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in text_slices(batches, "text"):
            out = []
            for key, text, tail in zip(*(b.column(i).to_pylist() for i in range(3))):
                if tail and held is None:
                    continue
                own = signature(text.encode())
                if held is not None:
                    other = edited(held[1], text)
                    raw = other.encode()
                    there = held[2] if other == held[1] else signature(raw)
                    out.append((held[0], len(held[1]), hashlib.sha256(raw).hexdigest(), text_of(held[2]), text_of(there), likeness(held[2], there), likeness(held[2], own)))
                held = None if tail else (key, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = with_tails(d, "doc_id", "text").select("doc_id", "text", "tail")
    return in_order.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir) -> DataFrame:
    return against_next(table(spark, sf_dir, "documents"))


QUERIES = {"op5_order_minhash": query}
