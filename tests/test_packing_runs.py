"""Merging graph rows into hits, fitting packs to a budget, the completion proxy and run tables, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate, graph, packs
from quarry.operators.runs import RunTable

HIT = "query_id long, id long, rank int, path string, topic string, text string, score double, matched array<string>, evidence array<string>, reasons array<string>, confidence double"
OFFER = "query_id long, id long, path string, text string, topic string, place int, reasons array<string>, evidence array<string>, confidence double"


def plain_merge(hits, offers, limit, room):
    """Row by row, as a loop would."""
    out, by_id = [], {h["id"]: h for h in hits}

    def add(row, receipt, dedupe):
        if len(out) >= limit:
            return False
        for o in out:
            if dedupe and o["path"] == row["path"] or o["id"] == row["id"]:
                for k in ("reasons", "evidence"):
                    o[k] = list(dict.fromkeys(o[k] + receipt.get(k, [])))
                o["confidence"] = max(o["confidence"], receipt.get("confidence", 0))
                return False
        base = by_id.get(row["id"], {"reasons": [], "evidence": [], "confidence": 0.0})
        out.append({"id": row["id"], "path": row["path"], "reasons": list(dict.fromkeys(base["reasons"] + receipt.get("reasons", []))), "evidence": list(dict.fromkeys(base["evidence"] + receipt.get("evidence", []))), "confidence": max(base["confidence"], receipt.get("confidence", 0))})
        return True

    add(hits[0], {}, False)
    taken = 0
    for o in offers:
        if taken >= room:
            break
        taken += add(o, o, True)
    for h in hits[1:]:
        add(h, {}, False)
    return [(o["id"], o["path"], tuple(o["reasons"]), tuple(o["evidence"]), o["confidence"]) for o in out]


@pytest.mark.parametrize("room,limit", [(0, 4), (1, 5), (2, 5), (2, 3), (5, 20)])
def test_merge_by_brute_force(spark, room, limit):
    r = random.Random(room * 10 + limit)
    hits, offers, want = [], [], {}
    for q in range(30):
        own, given = [], []
        for k in range(r.randrange(1, 8)):
            own.append(dict(query_id=q, id=k, rank=k + 1, path=f"p{r.randrange(6)}", topic="t", text="x", score=k / 10, matched=[], evidence=[f"e{k}"], reasons=["hit"], confidence=r.choice([0.5, 0.9])))
        for k in range(r.randrange(0, 7)):
            n = r.randrange(12)
            path = next((h["path"] for h in own if h["id"] == n), f"p{r.randrange(9)}")
            given.append(dict(query_id=q, id=n, path=path, text="x", topic="t", place=k + 1, reasons=[f"g{k}"], evidence=[f"via {k}"], confidence=0.8))
        if len({(g["id"], g["path"]) for g in given}) < len(given) or len({g["id"] for g in given}) < len(given):
            given = given[:1]
        hits += own
        offers += given
        want[q] = plain_merge(own, given, limit, room)
    got = graph.merge_into(spark.createDataFrame([tuple(h[c.split()[0]] for c in HIT.split(", ")) for h in hits], HIT), spark.createDataFrame([tuple(o[c.split()[0]] for c in OFFER.split(", ")) for o in offers], OFFER), limit, room)
    rows = {}
    for x in got.orderBy("query_id", "rank").collect():
        rows.setdefault(x.query_id, []).append((x.id, x.path, tuple(x.reasons), tuple(x.evidence), x.confidence))
    assert rows == want


def pack_rows(spark, seed, queries=40):
    r = random.Random(seed)
    words = ["alpha", "é", "\n", "bêta", "x" * 30, "\n\n", "😀😀"]
    rows = []
    for q in range(queries):
        for place in range(1, r.randrange(2, 6)):
            text = r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randrange(1, 120)))])
            rows.append((q, place, q * 10 + place, r.choice([None, "a/é.py", "b.go"]), text, r.choice(["", "\n> ranked match; é, b"])))
    return rows


def rendered(rows):
    return "\n\n".join(f"### {path or ''}\n```\n{content}\n```{note}" for path, content, note in rows).encode()


@pytest.mark.parametrize("budget", [512, 700, 1500, 12_000])
def test_fit_by_brute_force(spark, budget):
    """What is returned renders to used_bytes, within the budget, and nothing more would fit."""
    data = pack_rows(spark, budget)
    fitted = packs.fit(spark.createDataFrame(data, "query_id long, place int, id long, path string, text string, note string"), budget)
    shown = {r.query_id: r.markdown.encode() for r in packs.render(fitted).collect()}
    got = {}
    for r in fitted.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {d[0] for d in data}
    for q, rows in got.items():
        own = [(p, t or "", n) for k, _, _, p, t, n in data if k == q]
        body = rendered([(r.path, r.content, r.note) for r in rows])
        assert shown[q] == body and len(body) == rows[-1].used_bytes <= budget
        assert [r.truncated for r in rows[:-1]] == [False] * (len(rows) - 1) and [r.place for r in rows] == list(range(1, len(rows) + 1))
        for (p, t, n), r in zip(own, rows):
            assert r.note in (n, "") and (r.content == t if not r.truncated else t.startswith(r.content.removesuffix(packs.MARKER)) and r.content.endswith(packs.MARKER))
        last, k = rows[-1], len(rows)
        if last.truncated:
            assert len(rendered(own[:k])) > budget  # it didn't fit as a whole
            kept = len(last.content.removesuffix(packs.MARKER).encode())
            whole_line = own[k - 1][1].encode()[kept : kept + 1] == b"\n"
            assert whole_line or budget - len(body) < 4
        elif k < len(own):  # not even a little of the next one fits
            p, t, n = own[k]
            assert len(body) + len(rendered([("", "", "")])) - 4 + len((p or "").encode()) + len(n.encode()) + 4 + len(packs.MARKER) + packs.PIECE > budget - 8
        if any(n and not r.note for (_, _, n), r in zip(own, rows)):
            assert k == 1  # notes go last


def test_quality_is_told_where_there_is_any(spark):
    packed = spark.createDataFrame([(1, 1, "a.py", "x", ""), (2, 1, "b.py", "y", ""), (3, 1, "c.py", "z", "")], "query_id long, place int, path string, content string, note string")
    told = spark.createDataFrame([(1, 0.83, "strong"), (2, 0.0, "weak")], "query_id long, score double, grade string")
    got = {r.query_id: r.markdown for r in packs.render(packed, told).collect()}
    assert got == {1: "Quality: strong (0.83)\n\n### a.py\n```\nx\n```", 2: "### b.py\n```\ny\n```", 3: "### c.py\n```\nz\n```"}


def test_selection_counts_evidence_before_a_row(spark):
    row = lambda i, score, evidence=(), confidence=0.55, matched=(): (1, i, i, "p", "t", "x", score, list(matched), list(evidence), ["r"], confidence)
    rows = [row(1, 0.1), row(2, 0.3, matched=["m"]), row(3, 0.9, ["e"]), row(4, 0.4, matched=["m"]), row(5, 0.9, confidence=0.7), row(6, 0.3, matched=["m"]), row(7, 0.15), row(8, 0.9)]
    got = packs.select(spark.createDataFrame(rows, HIT), 10).orderBy("place").collect()
    assert [(r.id, r.place) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (7, 6)]


def test_completion_proxy_by_hand(spark):
    cases = spark.createDataFrame([(1, "let total of", "let netSum of rows", "netSum", 7), (2, "a b", "a b", "", 9), (3, "none", "missing words", "missing", 5)], "query_id long, prompt string, next_line string, identifier string, gold long")
    tops = spark.createDataFrame([("x", 1, 8, 1), ("x", 1, 7, 2), ("x", 1, 6, 9), ("y", 1, 6, 1), ("x", 2, 9, 1), ("y", 2, 6, 1), ("x", 3, None, None)], "system string, query_id long, id long, rank int")
    corpus = spark.createDataFrame([(6, "rows"), (7, "the netSum is"), (8, "of rows"), (9, None)], "id long, text string")
    got = {(r.system, r.query_id): (r.gold_rank, round(r.coverage, 3), r.identifier_hit, r.hit1, r.hit3) for r in evaluate.completion_proxy(cases, tops, corpus).collect()}
    assert got == {("x", 1): (2, 1.0, True, False, True), ("y", 1): (None, 0.5, False, False, False), ("x", 2): (1, 0.0, False, True, True), ("y", 2): (None, 0.0, False, False, False), ("x", 3): (None, 0.0, False, False, False)}


def test_a_run_that_stops_goes_on_where_it_was(spark, tmp_path):
    cases = spark.range(40).withColumnRenamed("id", "case").unionByName(spark.createDataFrame([(None,)], "case long"))
    table = RunTable(spark, f"file://{tmp_path}/runs", "case", "case bigint, score double", slices=4)
    seen = []

    def work(rows):
        seen.append(rows.count())
        if len(seen) == 3:
            raise RuntimeError("power cut")
        out = rows.filter("case is null or case <> 13").withColumn("score", F.lit(0.5))
        return out.withColumn("failed", F.when(F.col("case") % 10 == 7, "bad"))

    with pytest.raises(RuntimeError):
        table.go("a", cases, work)
    half = {r.case for r in table.table("a").collect()}
    assert 0 < len(half) < 41
    again = []

    def rest(rows):
        again.extend(r.case for r in rows.collect())
        return rows.withColumn("score", F.lit(1.0)).withColumn("failed", F.lit(None).cast("string"))

    failed = {r.case for r in table.table("a").filter("failed is not null").collect()}
    assert {r.case for r in table.left("a", cases).collect()} == ({None, *range(40)} - half) | failed
    RunTable(spark, f"file://{tmp_path}/runs", "case", "case bigint, score double", slices=4).go("a", cases, rest)
    assert set(again) == ({None, *range(40)} - half) | failed and len(again) == len(set(again))
    s = table.summary("a", cases, ["score"]).head()
    assert (s["cases"], s.done, s.failed) == (41, 41, 0) and s.score == pytest.approx((len(half - failed) * 0.5 + len(again)) / 41)
    assert table.go("a", cases, rest) == 0
    assert table.summary("b", cases, ["score"]).head().done == 0
