import hashlib
import random
import zlib
from collections import Counter

import pytest

from quarry.llm import op13_merkle as M

H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
KIND = "doc_id long, source string, lang string, n_chars long, text string, grp string, unit int, proof int, total int"


def tree(leaves):
    """(root, each leaf's siblings before and after it, level by level)."""
    level, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            proofs[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        at, level = [i // 3 for i in at], [H(level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def leaf(row):
    return H("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row)


def brute(rows):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    root, upper = tree([trees[s][0] for s in order])
    for s, over in zip(order, upper):
        for r, proof in zip(groups[s], trees[s][1]):
            proof = proof + over
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            d = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
            for a, b in proof:
                d = H([a, d, b])
            out.append((r[0], leaf(r), trees[s][0], root, H(x for p in proof for x in p), d, d == root))
    return out


def rows(seed, n):
    r = random.Random(seed)
    sources = [None, "", "-", "s", "a", "é", "z", "hot", "hot", "hot", "hot"]
    out = [(r.randrange(n), r.choice(sources), r.choice([None, "en", "é"]), r.choice([None, 5]), r.choice([None, "", "a\nb", "é\n" * 3, f"text {k}"])) for k in range(n)]
    out += [(None, "hot", "en", 1, "no\nid"), (None, None, None, None, None), (1, "single", "en", 1, "x" * 1_000_000 + "\n")]
    return out + [(3, "hot", "en", 1, "again\n")] * 40


@pytest.mark.parametrize("n,unit,block,wider", [(400, 5, 2, 1), (300, 64, 3, 2), (200, 4096, 12, 6), (0, 7, 1, 1)])
def test_by_brute_force(spark, tmp_path, monkeypatch, n, unit, block, wider):
    """Small units and subtrees make many frontiers and rounds."""
    monkeypatch.setattr(M, "UNIT", unit)
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "WIDER", wider)
    data = rows(n, n) if n else [(5, "one", "en", 3, "a\nb")]
    spark.createDataFrame([(*x, "own", 1, 2, 3) for x in data], KIND).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.query(spark, str(tmp_path)).collect()
    want = brute(data)
    assert Counter(map(tuple, got)) == Counter(want)
    assert n == 0 or {True, False} == {w[-1] for w in want}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    assert M.query(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 82])
def test_events_in_any_order(n):
    leaves = [H([str(k)]) for k in range(n)]
    order = list(range(n))
    random.Random(n).shuffle(order)
    up = M.Parents(n)
    done = {(level, idx): digest for k in order for level, idx, _, digest in up.child(0, k, leaves[k])}
    assert (done[up.top, 0] if n > 1 else leaves[0]) == tree(leaves)[0]
    assert not up.waiting and M.height(n) == up.top and len(done) == sum(up.widths[1:])
