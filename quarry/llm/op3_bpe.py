"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token is a linked list of symbols.  For each merge rank there is a bucket
of list positions, and a three-level bitmap (64 bits a word) says which buckets
hold any: find-first-set at each level gives the next rank.  A popped position
whose pair has changed since is stale and skipped.  So a merge costs constant
time, and a pre-token of a million bytes costs no more per byte than a short one
(about 40 bytes of memory each).

Cases: text null counts as empty (no ids, the hash of nothing); ranks that lack
a byte raise an error; repeated rows are each encoded; further columns are left.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, table, text_slices
from .pretok import Cache, pretokens

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words whose ids a worker keeps; in the pipeline, where workers hold other stages' data too, half as many.
CACHE_WORDS, STAGE_CACHE_WORDS = 500_000, 250_000
#: Bytes of words that are encoded together.
GROUP_BYTES = 1 << 18
#: Ids that are written out at a time.
_CHUNK = 1 << 16


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values(), default=0) + 1
        self.bytes = [b""] * top
        for b, r in ranks.items():
            self.bytes[r] = b
        self.first = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.start = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        #: Every pair of ids whose bytes together have a rank.
        self.pairs = {ranks[w[:i]] << 32 | ranks[w[i:]]: r for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}
        self.sizes = top // 64 + 1, top // 4096 + 1, top // 262_144 + 1

    def encode(self, data: bytes) -> list[int]:
        return list(map(int, self.encode_many([data])[0]))

    def encode_many(self, words: list[bytes]) -> list:
        """Each word's ids, in groups of GROUP_BYTES: one queue serves a group, as the least rank of all is the least of its own words too."""
        out: list = [[r] if (r := self.ranks.get(w)) is not None else None for w in words]
        group, size = [], 0
        for k, w in enumerate(words):
            if out[k] is None:
                if group and size + len(w) > GROUP_BYTES:
                    self._encode(words, group, out)
                    group, size = [], 0
                group.append(k)
                size += len(w)
        if group:
            self._encode(words, group, out)
        return out

    def _encode(self, words: list[bytes], group: list[int], out: list) -> None:
        data = np.frombuffer(b"".join([words[k] for k in group]), np.uint8)
        n = len(data)
        ids = self.first[data]
        if n and ids.min() < 0:
            raise ValueError("the ranks lack a byte")
        ends = np.cumsum([len(words[k]) for k in group], dtype=np.int64)
        last = np.unique(ends[ends > 0]) - 1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ranks = np.append(self.start[data[:-1].astype(np.int32) << 8 | data[1:]], np.int32(-1))[:n]
        if n:
            after[last], ranks[last], before[np.append(0, last[:-1] + 1)] = n, -1, -1
        # a long word's numbers are held in four bytes each; lists are quicker for the rest
        small = n <= GROUP_BYTES
        hold = (lambda x: x.tolist()) if small else (lambda x: array("i", x.tobytes()))
        ids, after, before = hold(ids), hold(after), hold(before)
        self._merge(ids, after, before, ranks, n, hold)
        at = 0
        for k, end in zip(group, ends.tolist()):
            if small:
                out[k] = [x for x in ids[at:end] if x >= 0]
            else:
                left = np.frombuffer(ids, np.int32)[at:end]
                out[k] = left[left >= 0]
            at = end

    def _merge(self, ids, after, before, ranks: np.ndarray, n: int, hold) -> None:
        """ids of merged-away places become -1."""
        w0, w1, w2 = ([0] * k for k in self.sizes)
        buckets: dict = {}
        rank_of = self.pairs.get

        def mark(r: int) -> None:
            w0[r >> 6] |= 1 << (r & 63)
            w1[r >> 12] |= 1 << (r >> 6 & 63)
            w2[r >> 18] |= 1 << (r >> 12 & 63)

        places = np.flatnonzero(ranks >= 0).astype(np.int32)
        places = places[np.argsort(ranks[places], kind="stable")]
        found, edge = np.unique(ranks[places], return_index=True)
        edge = [*edge.tolist(), len(places)]
        for k, r in enumerate(found.tolist()):
            buckets[r] = hold(places[edge[k] : edge[k + 1]])
            mark(r)
        del places
        none, small = hold(np.zeros(0, np.int32)), n <= GROUP_BYTES
        while buckets:
            for k, x in enumerate(w2):  # find first set, level by level
                if x:
                    break
            k = k << 6 | (x & -x).bit_length() - 1
            x = w1[k]
            k = k << 6 | (x & -x).bit_length() - 1
            x = w0[k]
            r = k << 6 | (x & -x).bit_length() - 1
            spots = buckets.pop(r)
            w0[k] = x = x & (x - 1)
            if not x:
                w1[k >> 6] = x = w1[k >> 6] & ~(1 << (k & 63))
                if not x:
                    w2[k >> 12] &= ~(1 << (k >> 6 & 63))
            if isinstance(spots, list):
                spots.sort()
            else:
                spots = array("i", np.sort(np.frombuffer(spots, np.int32)).tobytes())
            lower = False
            for at, i in enumerate(spots):
                j = after[i]
                a = ids[i]
                if a < 0 or j == n or rank_of(a << 32 | ids[j]) != r:
                    continue  # stale
                ids[i], ids[j] = r, -1
                j = after[i] = after[j]
                if j != n:
                    before[j] = i
                    q = rank_of(r << 32 | ids[j])
                    if q is not None:
                        if q in buckets:
                            buckets[q].append(i)
                        else:
                            buckets[q] = [i] if small else array("i", (i,))
                            mark(q)
                            lower |= q < r
                h = before[i]
                if h >= 0:
                    q = rank_of(ids[h] << 32 | r)
                    if q is not None:
                        if q in buckets:
                            buckets[q].append(h)
                        else:
                            buckets[q] = [h] if small else array("i", (h,))
                            mark(q)
                            lower |= q < r
                if lower:  # only for ranks that no training gives: a new pair goes before the rest of this bucket
                    if at + 1 < len(spots):
                        buckets[r] = spots[at + 1 :] + buckets.pop(r, none)
                        mark(r)
                    break


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _encoder(name: str, cache_words: int = CACHE_WORDS) -> tuple[Encoder, Cache]:
    """Words' ids are kept as bytes of 32-bit numbers, or 16-bit ones where they fit: a third of what a list takes."""
    import public_tokenizers

    encoder = Encoder(load_ranks(public_tokenizers.path(name)))
    encoder.code = "H" if len(encoder.bytes) <= 1 << 16 else "I"
    encoder.decimals = [str(i) for i in range(len(encoder.bytes))]

    def make(words: list[str]):
        found = encoder.encode_many([w.encode() for w in words])
        return zip(words, (array(encoder.code, ids).tobytes() if isinstance(ids, list) else ids.astype(encoder.code).tobytes() for ids in found))

    return encoder, Cache(make, cache_words)


def _ids(encoder: Encoder, cache: Cache, words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(cache.of(words)), encoder.code)


def encode_text(text: str, name: str = RANKS) -> list[int]:
    return _ids(*_encoder(name), pretokens(text)).tolist()


def encode(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id, ids array<int>: a map over whole texts, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            ids = [_ids(*_encoder(name), pretokens(t or "")).astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return pick(docs, "doc_id", "text").mapInArrow(run, _schema(docs, "ids array<int>"))


def decode_bytes(ids: list[int], name: str = RANKS) -> bytes:
    table = _encoder(name)[0].bytes
    return b"".join([table[i] for i in ids])


def _schema(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {rest}"


def digests(docs: DataFrame, name: str = RANKS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, then decodes its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache = _encoder(name, cache_words)
        piece, decimal = encoder.bytes.__getitem__, encoder.decimals.__getitem__
        for b in text_slices(batches, "text", 2 << 20):
            n, ids_sha, text_sha = [], [], []
            texts = [pretokens(t or "") for t in b.column(1).to_pylist()]
            cache.ready(chain.from_iterable(texts))  # new words are encoded together
            for words in texts:
                ids = _ids(encoder, cache, words)
                n.append(len(ids))
                own, decoded = hashlib.sha256(), hashlib.sha256()
                for at in range(0, len(ids), _CHUNK):
                    some = ids[at : at + _CHUNK].tolist()
                    own.update((("," if at else "") + ",".join(map(decimal, some))).encode())
                    decoded.update(b"".join(map(piece, some)))
                ids_sha.append(own.hexdigest())
                text_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").mapInArrow(run, _schema(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For the pipeline's end: what op3's query returns, over the documents left."""
    return digests(docs, cache_words=STAGE_CACHE_WORDS)


def query(spark, sf_dir) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op3_byte_bpe_rank_queue": query}
