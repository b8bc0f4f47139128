import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from quarry.llm import op3_bpe as B


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.load_ranks(public_tokenizers.path(B.RANKS)), special_tokens={})


def test_same_ids_as_the_library(reference):
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice(["the", "ing", " ", "é", "ß", "'s", "\n", "1", "٣", "😀", "<|endoftext|>", "x"]) for _ in range(r.randrange(25)))
        assert B.encode_text(t) == reference.encode_ordinary(t)
        assert B.decode_bytes(B.encode_text(t)) == t.encode()


def test_very_long_pretoken(reference):
    t = "".join(random.Random(3).choice("abcdé") for _ in range(60_000))
    assert B.encode_text(t) == reference.encode_ordinary(t)
    assert B.decode_bytes(B.encode_text("a" * 300_000)) == b"a" * 300_000


def brute(ranks, word):
    parts = [bytes([c]) for c in word]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_any_ranks_in_any_order():
    """Also where a merge makes a pair of a lower rank, which no training gives."""
    r = random.Random(5)
    for _ in range(200):
        pieces = list({bytes(r.choice(b"ab") for _ in range(r.randrange(2, 5))) for _ in range(6)})
        r.shuffle(pieces)
        names = [*pieces[:3], b"a", b"b", *pieces[3:]]
        ranks = {p: i for i, p in enumerate(names)}
        e = B.Encoder(ranks)
        words = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 14))) for _ in range(20)]
        assert e.encode_many(words) == [[ranks[w]] if w in ranks else brute(ranks, w) for w in words]


def test_lacking_byte():
    with pytest.raises(ValueError):
        B.Encoder({b"a": 0}).encode(b"ab")


def test_digests(spark, docs, reference):
    rows = [(1, None), (2, ""), (3, "Hello  world\n"), (3, "Hello  world\n"), (None, "ß" * 5000), (4, " " * 3000)]
    got = sorted(B.digests(docs(rows)).collect(), key=str)
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert B.digests(docs([])).count() == 0
    assert {r.doc_id: r.ids for r in B.encode(docs(rows[2:3])).collect()} == {3: reference.encode_ordinary(rows[2][1])}


def test_memory_of_a_long_pretoken():
    """Eight megabytes in one pre-token: right, and in bounded memory a byte."""
    import subprocess
    import sys

    code = """
import random, resource, sys
from quarry.llm import op3_bpe as B
import public_tokenizers
e = B.Encoder(B.load_ranks(public_tokenizers.path(B.RANKS)))
r = random.Random(1)
data = bytes(r.choice(b'abcdefgh') for _ in range(8_000_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids = e.encode_many([data])[0]
used = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
assert b''.join(e.bytes[i] for i in ids.tolist()) == data
head = e.encode_many([data[:200_000]])[0]
assert ids[:50_000].tolist() == list(head)[:50_000]
print(used)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 500
