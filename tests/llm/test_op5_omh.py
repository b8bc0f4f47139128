import hashlib
import random

import numpy as np
import pytest

from quarry.llm import op5_omh as O
from quarry.llm.words import mix


def slow_pieces(data):
    if len(data) < O.K:
        return O.pieces(data).tolist()
    seen, out = {}, []
    bits = max(1, (len(data) - O.K).bit_length())
    for i in range(len(data) - O.K + 1):
        x = int(mix(np.array([int.from_bytes(data[i : i + 8], "little")], np.uint64))[0])
        k = x >> bits
        n = seen.get(k, 0)
        seen[k] = n + 1
        if n:
            x = int(mix(np.array([x], np.uint64) + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[0])
        out.append(x >> 32)
    return out


def slow_signature(data):
    x = slow_pieces(data)
    out = []
    for a, b in zip(O._A.tolist(), O._B.tolist()):
        ranked = sorted((((a * h + b) & 0xFFFFFFFF, i) for i, h in enumerate(x)))[: O.PICKS]
        out.append(tuple(x[i] for _, i in sorted(ranked, key=lambda p: p[1])))
    return out


@pytest.mark.parametrize("text", ["", "a", "short", "12345678", "ab" * 40, "the cat sat on the mat and the cat sat", "é" * 30])
def test_tuples_by_brute_force(text):
    """Slots are equal just where the brute-force tuples are."""
    other = text[: len(text) // 2] + "something else entirely"
    a, b = slow_signature(text.encode()), slow_signature(other.encode())
    assert [x == y for x, y in zip(a, b)] == (O.signature(text.encode()) == O.signature(other.encode())).tolist()


def test_steps_make_no_difference(monkeypatch):
    t = ("".join(random.Random(1).choice("abcdef ") for _ in range(5000))).encode()
    whole = O.signature(t)
    monkeypatch.setattr(O, "_STEP", 100)
    assert (O.signature(t) == whole).all()


def test_order_counts():
    r = random.Random(2)
    blocks = ["".join(r.choice("abcdefghij") for _ in range(40)) for _ in range(30)]
    near = blocks[:]
    near[5] = "x" * 40
    shuffled = blocks[:]
    r.shuffle(shuffled)
    sig = lambda b: O.signature("".join(b).encode())
    assert O.likeness(sig(blocks), sig(near)) > 0.7 > O.likeness(sig(blocks), sig(shuffled)) + 0.1
    assert O.likeness(sig(blocks), sig(blocks)) == 1.0


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_against_next(spark, docs, parts):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abc é😀") for _ in range(r.randrange(0, 300)))) for i in range(0, 60, 2)] + [(None, "first"), (7, None), (8, ""), (8, "tie"), (8, "tie"), (90, "z" * 50_000)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = O.against_next(docs(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        s, se, sn = (O.signature(x.encode()) for x in (t, e, nxt))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), O.text_of(s), O.text_of(se), O.likeness(s, se), O.likeness(s, sn)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_small_tables(spark, docs):
    assert O.against_next(docs([])).count() == 0
    one = O.against_next(docs([(1, "abcdefghijkl")])).head()
    assert one.near_next == 1.0
    assert O.fingerprints(docs([(1, "x"), (2, "x")])).select("fingerprint").distinct().count() == 1
