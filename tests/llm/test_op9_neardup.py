import random
import re

import numpy as np
import pytest

from quarry.llm import op9_neardup as N
from quarry.llm.components import components


def shingles(t, size=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size=4):
    s = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        c = i if not s[k] else min(ids, default=None)
        out.append((i, len(s[k]), c, i == c))
    return sorted(out, key=str)


def family(seed, n=120):
    """Copies at likenesses about 0.8, chains, and documents that share a long passage only."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3000)
    passage, rows, seeds = [word() for _ in range(60)], [], []
    for i in range(n):
        kind = r.random()
        if kind < 0.3 or not seeds:
            w = [word() for _ in range(r.choice([1, 2, 3, 4, 5, 9, 40, 120]))]
            seeds.append(w)
        elif kind < 0.8:
            w = list(r.choice(seeds))
            for _ in range(r.randrange(0, 1 + max(1, len(w) // 20))):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.5:
                seeds.append(w)
        else:
            w = passage + [word() for _ in range(40)]
        rows.append((i, " ".join(w).upper() if r.random() < 0.3 else "\t".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_by_brute_force(spark, docs, seed):
    rows = family(seed) + [(None, None), (500, ""), (501, " \n"), (None, "w1 w2"), (502, "w1 w2"), (503, "only me here now"), (503, "only me here now"), (504, "long " * 400_000), (505, "z" * 3_000_000), (None, "nobody else says this")]
    for size in (N.QUERY_SHINGLE, N.SHINGLE):
        got = N.near_duplicates(docs(rows), size).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, size)


def test_no_link_is_lost_where_stars_fail(spark, docs, monkeypatch):
    """Few, wide buckets: hubs miss most links, the prefix join finds them."""
    monkeypatch.setattr(N, "bands", lambda s: np.array([7], np.uint64))
    rows = family(9, 60)
    got = N.near_duplicates(docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 5)


def test_sets_that_share_a_name_stay_apart(spark, docs, monkeypatch):
    """Names of two bits: all the rest must come from the check."""
    real = N.node_of
    monkeypatch.setattr(N, "node_of", lambda s: (real(s)[0] & 3, real(s)[1]))
    rows = family(4, 60) + [(300, "a b c d e f"), (301, "a b c d e f")]
    got = N.near_duplicates(docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 5)


def test_words_that_polynomials_confuse(spark, docs):
    """Thue-Morse words of 2,048 bytes collide under any polynomial mod 2^64."""
    x, y = thue_morse(11)
    rows = [(1, f"a b c {x} d e f"), (2, f"a b c {y} d e f")]
    assert all(r.kept for r in N.near_duplicates(docs(rows), 4).collect())


def thue_morse(n):
    a, b = "x", "y"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_stage_leaves_own_columns(spark, docs):
    d = docs([(1, "a b c d e f"), (2, "a b c d e f")]).selectExpr("*", "doc_id * 5 near_duplicate_id", "'x' root", "'y' digest")
    out = N.stage(spark, d, "")
    assert out.columns == d.columns and [tuple(r) for r in out.collect()] == [tuple(r) for r in d.collect() if r.doc_id == 1]


def test_signatures_estimate_likeness():
    r = np.random.default_rng(4)
    for n in (3, 20, 300):
        hits = []
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.append(a[: max(1, int(n * 0.9))], r.integers(0, 1 << 63, n - max(1, int(n * 0.9)), dtype=np.uint64)))
            hits.append((N.signature(a) == N.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(hits)) < 0.08


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 101, 102)} == {100}


def test_stage_and_empty(spark, docs):
    d = docs([(1, "a b c d e"), (2, "A b c d e"), (3, "other words than these"), (4, None)])
    out = N.stage(spark, d, "")
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    assert N.near_duplicates(docs([])).count() == 0


def test_stage_decides_by_row(spark, docs):
    """Null and repeated ids: clean rows stay, of each component one row does."""
    a, b, clean = "one two three four five six", "seven eight nine ten eleven twelve", "nobody else says a thing like this"
    rows = [(1, a), (None, a), (None, clean), (2, b), (3, b), (3, "and this row is its own"), (4, "same row and same id"), (4, "same row and same id"), (None, "only null ids hold this one"), (None, "only null ids hold this one"), (5, ""), (5, ""), (None, None), (None, None)]
    got = N.stage(spark, docs(rows), "")
    want = [(1, a), (None, clean), (2, b), (3, "and this row is its own"), (4, "same row and same id"), (None, "only null ids hold this one"), (5, ""), (5, ""), (None, None), (None, None)]
    assert got.columns == docs(rows).columns
    assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=str) == sorted(want, key=str)


def test_many_rows_without_an_id_are_read_once_each(spark, docs, monkeypatch):
    """Rows that share a doc_id, or have none, aren't paired with each other."""
    import random

    r = random.Random(8)
    text = lambda: " ".join(r.choice(["one", "two", "three", "four", "five", "six", "seven"]) + str(r.randrange(50)) for _ in range(30))
    base = [text() for _ in range(300)]
    rows = [(None, t + " end") for t in base] + [(None, t + " fin") for t in base] + [(7, t + " end of it") for t in base[:100]]
    read = spark.sparkContext.accumulator(0)
    plain = N._set_rows

    def counted(size):
        run = plain(size)

        def wrapped(batches):
            def seen():
                for b in batches:
                    read.add(b.num_rows)
                    yield b

            yield from run(seen())

        return wrapped

    monkeypatch.setattr(N, "_set_rows", counted)
    got = N.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    assert 0 < read.value <= 2 * len(rows)
