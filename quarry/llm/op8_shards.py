"""Token-id shards with a minimal perfect hash index.

A shard is two files.  NAME.ids: the ids of its documents one after another,
little-endian, unsigned 16-bit if the vocabulary allows it, else 32-bit.  NAME.idx: the index, from document keys to
offsets into NAME.ids, laid out as INDEX says below.

The hash is built level by level: a level has GAMMA bits per key left; a key
alone on its bit there keeps it, the others go on to the next level; a key's
slot is the number of bits set before its own, so n keys fill n slots.  A slot
stores a 32-bit fingerprint of its key and its row: a lookup reads, for each level it
tries (two on average), a block of bits and the number of bits set before that, then a
fingerprint, a row and its offset, each by its place in the file; and an absent key is told by its
fingerprint (one in 2^32 slips through; the stored key then decides).

Shards hold ascending ranges of doc_id.  Task attempts name their files afresh
and only those in the manifest, which Spark commits, are read.

Cases: the strings of the vocabulary's added tokens in a text get those tokens' ids, as the library has it; text null counts as
empty (the end id alone); doc_id null comes before
every number and is kept beside the hash; of rows that share a doc_id the index
leads to the first, all are in the payload, in order of their text; an empty
table makes no shard; further columns are left.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, filesystem, fresh_dir, pick, table, text_slices, written
from .ordered import sorted_parts
from .pretok import Cache, pretokens
from .words import mix

VOCABULARY, END_ID, GAMMA, MAGIC = "byte_bpe_50k.json", 0, 2.0, b"IDSHARD2"
#: Bits of a level to each stored rank.
RANK_BITS = 512
CACHE_WORDS = 1_200_000
_U = np.uint64


class MinimalPerfectHash:
    """Of distinct 64-bit keys."""

    def __init__(self, bits: list[np.ndarray]):
        self.levels = bits
        self.before = np.cumsum([0, *(int(b.sum()) for b in bits)])
        self.ranks = [np.concatenate([[0], np.cumsum(b)[:-1]]).astype(np.int64) for b in bits]

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U((level * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        bits, left = [], np.asarray(keys, np.uint64)
        while len(left):
            size = max(1, int(GAMMA * len(left)))
            spot = cls._spot(left, len(bits), size)
            alone = np.bincount(spot, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[spot]]
            if len(bits) > 200:
                raise ValueError("keys are not distinct")
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level has its bit, so it is no key."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, b in enumerate(self.levels):
            if not len(left):
                break
            spot = self._spot(keys[left], level, len(b))
            hit = b[spot]
            out[left[hit]] = self.before[level] + self.ranks[level][spot[hit]]
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(np.asarray(keys, np.uint64) ^ _U(0xA5A5A5A5A5A5A5A5)) >> _U(32)).astype(np.uint32)


class Index:
    """INDEX: MAGIC; bytes of an id, counts of rows, slots and levels, the payload's length (u64); each level's size in bits (u64); for each level its bits, packed and
    filled up to whole blocks of RANK_BITS, and for each block the number of slots before it (u64); by slot fingerprint (u32) and row (u64); by row
    key (i64), is-null (u8), offset (u64).  Row i's ids lie from its offset to the next row's, or to the payload's end."""

    def __init__(self, keys: np.ndarray, null: np.ndarray, offsets: np.ndarray, total: int, width: int, hashed=None, prints=None, rows=None):
        self.keys, self.null, self.offsets, self.total, self.width = keys, null, offsets, total, width
        if hashed is None:
            own = np.flatnonzero(~null)
            distinct, first = np.unique(keys[own], return_index=True)
            distinct = distinct.view(np.uint64)
            hashed = MinimalPerfectHash.build(distinct)
            slot = hashed.slots(distinct)
            prints, rows = np.zeros(len(slot), np.uint32), np.zeros(len(slot), np.uint64)
            prints[slot], rows[slot] = fingerprint(distinct), own[first].astype(np.uint64)
        self.hashed, self.prints, self.rows = hashed, prints, rows

    def dump(self) -> bytes:
        out = [MAGIC, struct.pack("<5Q", self.width, len(self.keys), len(self.prints), len(self.hashed.levels), self.total)]
        out.append(np.array([len(b) for b in self.hashed.levels], "<u8").tobytes())
        for before, b in zip(self.hashed.before, self.hashed.levels):
            blocks = np.zeros(-(-len(b) // RANK_BITS) * RANK_BITS, bool)
            blocks[: len(b)] = b
            set_ = blocks.reshape(-1, RANK_BITS).sum(1)
            out += [np.packbits(blocks, bitorder="little").tobytes(), (before + np.cumsum(set_) - set_).astype("<u8").tobytes()]
        out += [self.prints.astype("<u4").tobytes(), self.rows.astype("<u8").tobytes(), self.keys.astype("<i8").tobytes(), self.null.astype("u1").tobytes(), self.offsets.astype("<u8").tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, data: bytes) -> Index:
        at = Layout(data)
        bits = [np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), spot), count=size, bitorder="little").astype(bool) for size, spot, _ in at.levels]
        part = lambda kind, count, spot: np.frombuffer(data, kind, count, spot)
        keys, null, offsets = part("<i8", at.n, at.keys), part("u1", at.n, at.null).astype(bool), part("<u8", at.n, at.offsets)
        return cls(keys, null, offsets, at.total, at.width, MinimalPerfectHash(bits), part("<u4", at.slots, at.prints), part("<u8", at.slots, at.rows))

    def find(self, keys) -> np.ndarray:
        """The row that holds each key's ids; -1 for absent keys."""
        keys = np.asarray(keys, np.int64)
        slot = self.hashed.slots(keys.view(np.uint64))
        out = np.full(len(keys), -1, np.int64)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.prints[slot[hit]] == fingerprint(keys[hit].view(np.uint64))]
        row = self.rows[slot[hit]].astype(np.int64)
        own = self.keys[row] == keys[hit]
        out[hit[own]] = row[own]
        return out

    def span(self, row: int) -> tuple[int, int]:
        return int(self.offsets[row]), int(self.offsets[row + 1]) if row + 1 < len(self.offsets) else int(self.total)


class Layout:
    """Where an index file's parts lie, from its head."""

    HEAD = 48

    def __init__(self, head: bytes):
        if head[:8] != MAGIC:
            raise ValueError("not an index")
        self.width, self.n, self.slots, many, self.total = struct.unpack_from("<5Q", head, 8)
        self.head = self.HEAD + 8 * many
        self.levels: list[tuple[int, int, int]] = []  # size, place of the bits, place of the ranks
        at = self.head
        for size in struct.unpack_from(f"<{many}Q", head, self.HEAD) if len(head) >= self.head else ():
            blocks = -(-size // RANK_BITS)
            self.levels.append((size, at, at + blocks * RANK_BITS // 8))
            at += blocks * (RANK_BITS // 8 + 8)
        self.prints = at
        self.rows = self.prints + 4 * self.slots
        self.keys = self.rows + 8 * self.slots
        self.null = self.keys + 8 * self.n
        self.offsets = self.null + self.n


class IndexFile:
    """Lookups in an index that stays on disk: its head is read once, then a key takes a few short reads at known places, however many keys there are."""

    def __init__(self, file):
        self.file = file
        head = file.read_at(Layout.HEAD, 0)
        many = Layout(head).head - Layout.HEAD
        self.at = Layout(head + (file.read_at(many, Layout.HEAD) if many else b""))

    def _read(self, kind: str, at: int) -> int:
        return int(np.frombuffer(self.file.read_at(np.dtype(kind).itemsize, at), kind)[0])

    def row(self, key: int) -> int:
        """The row that holds the key's ids; -1 if there is none."""
        own = np.array([key], np.int64).view(np.uint64)
        for level, (size, bits, ranks) in enumerate(self.at.levels):
            spot = int(MinimalPerfectHash._spot(own, level, size)[0])
            block, bit = divmod(spot, RANK_BITS)
            held = np.unpackbits(np.frombuffer(self.file.read_at(RANK_BITS // 8, bits + block * RANK_BITS // 8), np.uint8), bitorder="little")
            if held[bit]:
                slot = self._read("<u8", ranks + 8 * block) + int(held[:bit].sum())
                if self._read("<u4", self.at.prints + 4 * slot) != int(fingerprint(own)[0]):
                    return -1
                row = self._read("<u8", self.at.rows + 8 * slot)
                return row if self._read("<i8", self.at.keys + 8 * row) == key else -1
        return -1

    def span(self, row: int) -> tuple[int, int]:
        begin = self._read("<u8", self.at.offsets + 8 * row)
        return begin, self._read("<u8", self.at.offsets + 8 * (row + 1)) if row + 1 < self.at.n else self.at.total


@functools.cache
def _library(name: str):
    """One a worker: a second one costs memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True  # words are what lies between added tokens, or ordinary text throughout
    return t


@functools.cache
def _words(name: str) -> tuple[Cache, int]:
    """(the cache of words' ids as bytes, bytes of an id)."""
    t = _library(name)
    width = 2 if t.get_vocab_size() <= 1 << 16 else 4
    code = "H" if width == 2 else "I"

    def make(words: list[str]):
        return zip(words, (array(code, e.ids).tobytes() for e in t.encode_batch_fast(words, add_special_tokens=False)), strict=True)

    return Cache(make, CACHE_WORDS), width


@functools.cache
def _added(name: str):
    """(a function that splits a text at the vocabulary's added tokens, which it gives at odd places; their ids as bytes)."""
    width = _words(name)[1]
    own = _library(name).get_added_tokens_decoder()
    if any(a.single_word or a.lstrip or a.rstrip for a in own.values()):
        raise ValueError(f"{name} has added tokens that depend on what is around them")
    ids = {a.content: i.to_bytes(width, "little") for i, a in own.items()}
    if not ids:
        return (lambda t: [t]), ids
    return re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")").split, ids


def encode(texts: list[str], name: str = VOCABULARY, added: bool = False) -> list[bytes]:
    """Each text's ids, little-endian.  The library sees each distinct pre-token once: this vocabulary's pre-tokenizer never joins them.

    added: the vocabulary's added tokens get their own ids, as the library gives them by default; else they are ordinary text."""
    cache = _words(name)[0]
    split, own = _added(name) if added else (lambda t: [t], {})
    pieces = [split(t) for t in texts]
    words = [[pretokens(x) for x in p[::2]] for p in pieces]
    cache.ready(chain.from_iterable(chain.from_iterable(words)))
    return [b"".join(chain(cache.of(w[0]), *((own[x], *cache.of(v)) for x, v in zip(p[1::2], w[1:])))) for p, w in zip(pieces, words)]


def write(docs: DataFrame, uri: str, name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """The shards; their manifest: shard (ascending), name, rows, ids."""
    schema = "shard int, name string, n_rows bigint, n_ids bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, home = filesystem(uri)
        fs.create_dir(home, recursive=True)
        own, width = uuid.uuid4().hex, _words(name)[1]
        end = end_id.to_bytes(width, "little")
        out, part, at, keys, null, offsets = None, None, 0, [], [], []
        for b in text_slices(batches, "text", 2 * SLICE_BYTES):
            if out is None:
                out, part = fs.open_output_stream(f"{home}/{own}.ids"), b.column(2)[0].as_py()
            chunk = []
            for key, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist(), name, added=True)):
                ids += end
                keys.append(key or 0)
                null.append(key is None)
                offsets.append(at)
                at += len(ids) // width
                chunk.append(ids)
            out.write(b"".join(chunk))
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{home}/{own}.idx") as f:
                f.write(Index(np.array(keys, np.int64), np.array(null, bool), np.array(offsets, np.uint64), at, width).dump())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own], pa.string()), pa.array([len(keys)], pa.int64()), pa.array([at], pa.int64())], ["shard", "name", "n_rows", "n_ids"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return written(sorted_parts(d, "doc_id", "text", n=n).select("doc_id", "text", "part").mapInArrow(run, schema), "id-manifest")


def lookup(fs, home: str, name: str, keys) -> list[np.ndarray | None]:
    """Keyed access: each key's ids by the index, None where absent; neither file is read as a whole."""
    out: list = []
    with fs.open_input_file(f"{home}/{name}.idx") as f, fs.open_input_file(f"{home}/{name}.ids") as payload:
        index = IndexFile(f)
        width = index.at.width
        for key in keys:
            row = index.row(int(key))
            a, b = index.span(row) if row >= 0 else (0, 0)
            out.append(np.frombuffer(payload.read_at((b - a) * width, a * width), f"<u{width}").astype("<u4") if row >= 0 else None)
    return out


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: each key goes through the index to its payload.

    start counts the ids of all shards before, a running sum over the manifest (a row per shard)."""
    started = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).withColumn("base", F.coalesce("base", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, home = filesystem(uri)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(f"{home}/{name}.idx") as f:
                    index = Index.load(f.read())
                rows = index.find(index.keys)
                lost = index.null | (rows != np.arange(len(rows)))  # null, or rows after the first of a doc_id
                if ((rows < 0) & ~index.null).any():
                    raise ValueError(f"the index of {name} lacks a key")
                rows[lost] = np.flatnonzero(lost)
                begin = index.offsets.astype(np.int64)
                end = np.append(begin[1:], index.total)
                crc = np.zeros(len(rows), np.int64)
                with fs.open_input_file(f"{home}/{name}.ids") as f:
                    at, top = 0, len(rows)
                    while at < top:  # neighbouring payloads are read together, SLICE_BYTES or one document at a time
                        to = max(at + 1, int(np.searchsorted(end, begin[at] + SLICE_BYTES, side="right")))
                        raw = f.read_at(int(end[to - 1] - begin[at]) * index.width, int(begin[at]) * index.width)
                        data = memoryview(np.frombuffer(raw, f"<u{index.width}").astype("<u4")).cast("B")
                        for i in rows[at:to].tolist():
                            crc[i] = zlib.crc32(data[(begin[i] - begin[at]) * 4 : (end[i] - begin[at]) * 4])
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(index.keys, mask=index.null), pa.array(begin + base), pa.array(end - begin), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return started.select("name", "base").repartition(n, "name").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark, sf_dir) -> DataFrame:
    uri = fresh_dir(spark, "id-shards")
    return read(write(table(spark, sf_dir, "documents"), uri), uri)


QUERIES = {"op8_id_shards": query}
