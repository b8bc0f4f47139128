import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import op11_packing as P


def one_by_one(counts, size):
    """Best-two-fit, bin by bin and piece by piece."""
    left, out = dict(counts), []
    while any(left.values()):
        own, gap = [], size
        while fit := [x for x in left if left[x] and x <= gap]:
            left[max(fit)] -= 1
            own.append(max(fit))
            gap -= max(fit)
        pair = None
        for x in sorted(left) if gap else []:
            for y in sorted(left):
                free = left[x] and left[y] > (x == y)
                if free and y >= x and own[-1] < x + y <= own[-1] + gap and (pair is None or x + y > sum(pair)):
                    pair = y, x
        if pair:
            left[own[-1]] += 1
            own[-1:] = pair
            for x in pair:
                left[x] -= 1
        out.append(own)
    return out


def test_plan_is_that_of_packing_one_by_one():
    r = random.Random(1)
    for _ in range(300):
        size = r.choice([10, 20, 37])
        counts = {r.randrange(1, size + 1): r.randrange(1, 30) for _ in range(r.randrange(1, 9))}
        bins = P.best_two_fit(counts, size)
        assert [b for n, b in bins for _ in range(n)] == one_by_one(counts, size)
        assert Counter(x for n, b in bins for x in b * n) == counts


def test_two_pieces_take_the_place_of_the_shortest():
    assert P.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [(1, [6, 2, 2]), (1, [3])]
    assert P.best_two_fit({}, 10) == []
    with pytest.raises(ValueError):
        P.best_two_fit({11: 1}, 10)


def test_plan_does_not_grow_with_the_corpus():
    counts = {k: 1 + k * 7919 % 10_007 for k in range(1, 1025)}
    small, large = P.plan(counts), P.plan({k: 10**7 * n for k, n in counts.items()})
    assert len(large) < 2 * len(small) < 20_000
    total = sum(k * n for k, n in counts.items())
    assert sum(n for n, _ in P.best_two_fit(counts, 1024)) <= 1.01 * -(-total // 1024)


def test_cut():
    doc, start, length = P.cut(np.array([1, 10, 11, 25]), 10)
    assert list(zip(doc.tolist(), start.tolist(), length.tolist())) == [(0, 0, 1), (1, 0, 10), (2, 0, 1), (2, 1, 10), (3, 0, 5), (3, 5, 10), (3, 15, 10)]


@pytest.mark.parametrize("size", [16, 1024])
def test_by_brute_force(spark, docs, size):
    r = random.Random(3)
    words = ["the ", "river", " é", "\n", "12", "<|endoftext|>", " stone"]
    rows = [(k, "".join(r.choice(words) for _ in range(r.randrange(60)))) for k in range(150)]
    rows += [(None, "no id"), (None, "no id"), (7, None), (8, ""), (9, ""), (9, "tie"), (9, "tie"), (500, "word " * 30_000)]
    whole = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    packed = P.pack(docs(rows).repartition(3), size)
    crc = {(g.sequence_id, g.offset): g.ids_crc32 for g in P.digests(packed).collect()}
    got = packed.collect()
    want, counts = [], Counter()
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, P.END_ID]
        short = (len(ids) - 1) % size + 1
        starts = [0, *range(short, len(ids), size)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            counts[b - a] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, crc[g.sequence_id, g.offset]) for g in got) == Counter(want)
    bins = {}
    for g in got:
        bins.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    assert Counter(tuple(sorted(n for _, n in b)) for b in bins.values()) == Counter(tuple(sorted(b)) for b in one_by_one(counts, size))
    whole_ = {s.sequence_id: s for s in P.sequences(packed).collect()}
    for g in got:
        s = whole_[g.sequence_id]
        assert s.ids[2 * g.offset : 2 * (g.offset + g.length)] == g.ids and len(s.ids) == 2 * s.n_tokens and g.doc_id in s.doc_ids


def test_empty(spark, docs):
    assert P.pack(docs([])).count() == 0
