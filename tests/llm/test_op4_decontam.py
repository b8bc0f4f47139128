import hashlib
import random
import re

import pytest

from quarry.llm import op4_decontam as D


def ws(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    grams = {}
    for i, t in bench:
        w = ws(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, items = ws(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    items |= grams[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "C", "ü", "x9"])
    line = lambda n: " ".join(word() + r.choice(["", ",", "!"]) for _ in range(n))
    bench = [(i, line(r.choice([0, 1, 3, 9, 10, 14, 30]))) for i in range(12)] + [(None, line(12)), (3, line(11)), (50, None), (51, "...")]
    docs = []
    for i in range(40):
        t = line(r.randrange(0, 60))
        if i % 3 == 0:
            t += " " + (r.choice(bench)[1] or "").upper() + " " + line(5)
        docs.append((i, t))
    return docs + [(None, None), (7, ""), (8, docs[3][1]), (8, docs[3][1]), (99, "a " * 3000)], bench


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_both_ways_by_brute_force(spark, docs, seed, limit):
    rows, bench = tables(seed)
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as hash")
    got = D.digest(D.decontaminate(docs(rows), b, limit)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, bench)


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_empty_tables(spark, docs, limit):
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.decontaminate(docs([]), b, limit).count() == 0
    assert D.digest(D.decontaminate(docs([(1, "a b")]), b.limit(0), limit)).head().n_hit == 0


def test_spans(spark, docs):
    b = spark.createDataFrame([(1, "k l m")], "item_id long, text string")
    r = D.decontaminate(docs([(1, "a k l m b k, L; m c")]), b).head()
    assert (r.starts, r.ends, r["items"]) == ([1, 5], [4, 8], ["1"])


def test_winnowing_guarantee():
    """Each shared window of WINDOW words has a kept gram on both sides."""
    import pyarrow as pa

    r = random.Random(9)
    for _ in range(50):
        shared = [r.choice("abcdef") * r.randrange(1, 4) for _ in range(10)]
        a, b = (D.words(pa.array([" ".join([r.choice("uvw") for _ in range(20)] + shared + [r.choice("uvw") for _ in range(20)])])) for _ in range(2))
        assert set(D.kept_grams(a)[1].tolist()) & set(D.kept_grams(b)[1].tolist())


def test_hundreds_of_thousands_of_hits_by_shuffle(spark, docs):
    """Hits are merged in one pass over them, whether they run together or stand apart."""
    b = spark.createDataFrame([(1, "k l m"), (2, "q r")], "item_id long, text string")
    rows = [(1, "k l m " * 60_000), (2, "q r z " * 60_000), (3, "z " * 1000)]
    got = {r.doc_id: r for r in D.digest(D.decontaminate(docs(rows), b, 0)).collect()}
    assert [(got[k].n_words, got[k].n_hit, got[k].n_items) for k in (1, 2, 3)] == [(180_000, 180_000, 1), (180_000, 120_000, 1), (1000, 0, 0)]
    spans = D.decontaminate(docs(rows), b, 0).filter("doc_id = 2").head()
    assert spans.starts == list(range(0, 180_000, 3)) and spans.ends == list(range(2, 180_000, 3))


def test_ids_of_items_count_for_the_broadcast(spark, docs, monkeypatch):
    used = []
    plain = D._by_shuffle
    monkeypatch.setattr(D, "_by_shuffle", lambda *a: used.append(1) or plain(*a))
    b = spark.createDataFrame([("i" * 100, "k l m")], "item_id string, text string")
    assert D.digest(D.decontaminate(docs([(1, "a k l m")]), b, 50)).head().n_hit == 3 and used
    used.clear()
    D.decontaminate(docs([(1, "a k l m")]), b, 200)
    assert not used
