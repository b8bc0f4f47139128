import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import op8_shards as S
from quarry.llm.common import filesystem, fresh_dir


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(S.VOCABULARY))
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_library(library):
    r = random.Random(1)
    texts = ["".join(r.choice(["the", "ing", " ", "é", "'s", "'S", "\n", "12", "٣", "😀", "<|endoftext|>", "x　"]) for _ in range(r.randrange(30))) for _ in range(300)]
    got = [np.frombuffer(b, "<u2").tolist() for b in S.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 10, 5000])
def test_minimal_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 60, n, replace=False).astype(np.uint64)
    h = S.MinimalPerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(n))


def test_index_round_trip_and_absent_keys():
    r = np.random.default_rng(2)
    keys = r.integers(-(1 << 62), 1 << 62, 1000)
    keys[10], null = keys[3], np.zeros(1000, bool)
    null[5] = True
    index = S.Index.load(S.Index(keys, null, np.arange(1000, dtype=np.uint64) * 3, 3000, 2).dump())
    found = index.find(keys)
    assert all(f == (3 if i == 10 else i) for i, f in enumerate(found) if i != 5)
    assert index.span(999) == (2997, 3000) and index.width == 2
    assert (index.find(r.integers(1 << 62, (1 << 63) - 1, 5000)) == -1).all()


@pytest.mark.parametrize("parts", ["1", "4"])
def test_by_brute_force(spark, docs, library, parts):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab c\né") for _ in range(r.randrange(200)))) for i in range(50, 0, -1)] + [(None, "null id"), (7, None), (8, ""), (9, "tie"), (9, "tie"), (99, "word " * 20_000)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        uri = fresh_dir(spark, "shards")
        manifest = S.write(docs(rows), uri)
        got = S.read(manifest, uri).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    start, want = 0, []
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*library.encode(t, add_special_tokens=False).ids, S.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    fs, home = filesystem(uri)
    ids = {}
    for m in manifest.collect():
        ids |= {k: v for k, v in zip([1, 50, 1234], S.lookup(fs, home, m["name"], [1, 50, 1234])) if v is not None}
    assert set(ids) == {1, 50}
    assert ids[50].tolist() == [*library.encode(dict(rows)[50], add_special_tokens=False).ids, S.END_ID]


def test_empty(spark, docs):
    uri = fresh_dir(spark, "shards")
    assert S.read(S.write(docs([]), uri), uri).count() == 0


def test_added_tokens_as_the_untouched_library(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path(S.VOCABULARY))
    r = random.Random(4)
    special = "<|endoftext|>"
    texts = ["abc <|endoftext|> def", special, special * 3, "a" + special, special + " b", "<|endoftext|", "x <|<|endoftext|>|>\n\n" + special + "  y"]
    texts += ["".join(r.choice(["the", "ing", " ", "é", "'s", "\n", "12", "😀", special, "<|", "|>", "x　"]) for _ in range(r.randrange(30))) for _ in range(300)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [39305, 220, 50256, 825]
    assert [np.frombuffer(b, "<u2").tolist() for b in S.encode(texts, added=True)] == want
    uri = fresh_dir(spark, "shards")
    got = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in S.read(S.write(docs(list(enumerate(texts))), uri), uri).collect()}
    at = 0
    for i, ids in enumerate(want):
        ids = [*ids, S.END_ID]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


class Counted:
    """A file in memory that counts what is read of it."""

    def __init__(self, data):
        self.data, self.reads, self.read = data, 0, 0

    def read_at(self, n, at):
        assert 0 <= at and at + n <= len(self.data)
        self.reads, self.read = self.reads + 1, self.read + n
        return self.data[at : at + n]


def test_a_lookup_reads_a_few_places_however_many_keys_there_are():
    cost = {}
    for n in (0, 1, 1000, 200_000):
        r = np.random.default_rng(n)
        keys = r.choice(1 << 60, n, replace=False).astype(np.int64) - (1 << 59)
        index = S.Index(keys, np.zeros(n, bool), np.arange(n, dtype=np.uint64) * 3, 3 * n, 2)
        file = Counted(index.dump())
        on_disk = S.IndexFile(file)
        asked = np.concatenate([keys[:200], r.integers(1 << 61, 1 << 62, 200)])
        assert [on_disk.row(int(k)) for k in asked] == index.find(asked).tolist()
        assert all(on_disk.span(k) == index.span(k) for k in range(min(n, 50)))
        opened = Counted(file.data)
        fresh = S.IndexFile(opened)
        head = opened.read
        for k in asked.tolist():
            fresh.row(k)
        cost[n] = (opened.read - head) / len(asked)
        assert head <= 48 + 8 * 64 and opened.reads <= 2 + 25 * len(asked)
    assert cost[200_000] < 2 * cost[1000] < 600
