import random
import re

import pytest

from quarry.llm import op7_substrings as D

W = D.WINDOW


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - W + 1):
                g = tuple(w[k : k + W])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - W + 1):
            if i is not None and first[tuple(w[k : k + W])] < i:
                gone |= set(range(k, k + W))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice(["a", "b", "cé", "D"]) for _ in range(n))
    common, rows = line(30), []
    for i in range(60):
        t = line(r.randrange(0, 50))
        if r.random() < 0.4:
            t += "\n" + common[r.randrange(20) :] + "\t" + line(5)
        if r.random() < 0.2 and rows:
            t = r.choice(rows)[1]
        rows.append((i, t))
    return rows + [(None, common), (None, None), (3, rows[9][1]), (200, "x " * 2000), (201, "x " * 2000), (201, "x " * 2000), (202, None), (203, "")]


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 2), (3, 4)])
def test_by_brute_force(spark, docs, seed, batches):
    rows = corpus(seed)
    got = D.dedup(docs(rows), batches).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark, docs):
    assert D.dedup(docs([])).count() == 0


def batches_of(rows, spark, docs, reopen):
    d = docs(rows, False)
    index, found = D.FingerprintIndex(spark, fanout=2), []
    for low, high in ((0, 20), (20, 40), (40, 60)):
        found.append(index.add(d.filter(f"doc_id >= {low} and doc_id < {high}"), d.filter(f"doc_id < {low}") if low else None))
        if reopen:  # as another session would: all it has is the folder
            index.close()
            index = D.FingerprintIndex(spark, index.home, fanout=2)
    return index, D.cleaned(d, found[0].unionByName(found[1]).unionByName(found[2]))


@pytest.mark.parametrize("reopen", [False, True])
def test_index_over_batches_and_compaction(spark, docs, reopen):
    """Three batches, added one by one, lose what they lose together; runs are merged, sorted, and hold every row."""
    rows = sorted([x for x in corpus(5) if x[0] is not None and x[0] < 60], key=lambda x: x[0])
    index, got = batches_of(rows, spark, docs, reopen)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert [level for level, _ in index.levels["runs"]] == [level for level, _ in index.levels["texts"]] == [1, 0]
    held = set()
    with D._planned(spark):
        for _, name in index.levels["runs"]:
            for part in index._table("runs", name).rdd.glom().collect():
                assert [r.key for r in part] == sorted(r.key for r in part)
                held |= {(r.fp or r.key, i) for r in part for i in r.docs}
    words = {}
    for i, t in rows:
        words.setdefault(t, i)
    import pyarrow as pa

    for t, i in words.items():
        assert {(int(f), i) for f in D.windows(D.Words(pa.array([t])))[1].view("int64")} <= held
    index.drop()


def test_older_runs_are_merge_joined_as_they_lie(spark, docs):
    """No exchange or sort above the scan of a run's cold rows; only the rows of common fingerprints are dealt anew."""
    rows = sorted([x for x in corpus(6) if x[0] is not None and x[0] < 60], key=lambda x: x[0])
    index, _ = batches_of(rows, spark, docs, False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with D._planned(spark):
            own = index._table("runs", index.levels["runs"][-1][1])
            plan = index.meeting(own)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scans = [k for k, x in enumerate(lines) if "Bucketed: true" in x and "isnull(fp" in x]
    assert len(scans) == 3
    for k in scans:  # the operators above, up to the join
        depth, above = lines[k].index("FileScan"), []
        for x in reversed(lines[:k]):
            at = len(x) - len(x.lstrip(" :+-"))
            if at < depth:
                depth = at
                above.append(x.strip(" :+-"))
            if "SortMergeJoin" in above[-1:] or above and above[-1].startswith("SortMergeJoin"):
                break
        assert above[-1].startswith("SortMergeJoin") and not any(x.startswith(("Exchange", "Sort ")) for x in above), above
    index.drop()


def test_words_that_polynomials_confuse(spark, docs):
    from .test_op9_neardup import thue_morse

    x, y = thue_morse(11)
    line = "a b c d e f g h i j k l m"
    rows = [(1, f"{line} {x} {line}"), (2, f"n {y} o p q r s t u v w x y z")]
    assert [r.n_removed for r in D.dedup(docs(rows), 1).orderBy("doc_id").collect()] == [0, 0]


def test_common_windows_and_long_texts(spark, docs, monkeypatch):
    """Fingerprints in many documents of a slice go to other buckets; texts of megabytes are judged whole."""
    monkeypatch.setattr(D, "LOCAL_HOT", 2)
    rows = corpus(8) + [(300, " ".join(f"w{k}" for k in range(300_000))), (301, " ".join(f"w{k}" for k in range(299_000, 300_000))), (302, "y" * 2_000_000)]
    got = D.dedup(docs(rows, False), 2).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_fingerprints_of_equal_windows_are_equal():
    import pyarrow as pa

    r = random.Random(7)
    shared = " ".join(r.choice("abcdef") for _ in range(W))
    a, b = (D.Words(pa.array([" ".join(r.choice("uvw") for _ in range(9)) + " " + shared + " q"])) for _ in range(2))
    (sa, fa), (sb, fb) = D.windows(a), D.windows(b)
    assert fa[sa.tolist().index(9)] == fb[sb.tolist().index(9)]
