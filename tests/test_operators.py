"""Small corpora with known outcomes."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import distance, fixed, text
from quarry.operators import evaluate, failure, graph, packs, retrieval, store
from quarry.sources import chunks, extract, files
from quarry.streaming import incremental


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(column.alias("x")).head().x if cols else spark.range(1).select(column.alias("x")).head().x


def lit_tokens(*words):
    return F.array(*[F.lit(w) for w in words])


class TestText:
    def test_identifier_split(self, spark):
        got = value(spark, text.identifier_tokens(F.col("t")), t="CacheStore HTTPServer cache_store parseURL v2Client")
        assert {"cachestore", "cache", "store", "httpserver", "http", "server", "cache_store", "parseurl", "parse", "url", "v2client", "client"} <= set(got)
        assert len(got) == len(set(got))

    def test_low_signal(self, spark):
        assert value(spark, text.drop_low_signal(lit_tokens("async", "def", "checkout", "12"))) == ["checkout"]
        assert value(spark, text.drop_low_signal(lit_tokens("return", "self"))) == ["return", "self"]

    def test_synonyms(self, spark):
        got = value(spark, text.expand_synonyms(lit_tokens("delete", "cache")))
        assert got[0] == "delete" and {"remove", "evict", "purge", "clear", "cache"} <= set(got)

    @pytest.mark.parametrize(
        "prompt,intent",
        [
            ("x = load(y)", "assignment"),
            ("def handle(a):", "declaration"),
            ("public void run()", "declaration"),
            ("import os\nfoo", "import"),
            ("raise broken", "exception"),
            ("run(fast)", "call"),
            ("# only\n// notes", "comment"),
            ("", "empty"),
            ("cache", "sparse"),
            ("several plain words here", "mixed"),
            ("@Test public broken", "declaration"),
        ],
    )
    def test_intent(self, spark, prompt, intent):
        assert value(spark, text.query_intent(F.col("t")), t=prompt) == intent

    def test_structure(self, spark):
        assert [value(spark, text.structure_intent(F.col("t")), t=t) for t in ("class A:", "  def f():", "async def g():", "x")] == ["class", "method", "function", ""]

    def test_languages(self, spark):
        assert [value(spark, text.language(F.col("t")), t=t) for t in (".PY", "Objective-C", "go lang", "zig")] == ["py", "m", "go", "zig"]
        assert [value(spark, text.path_language(F.col("t")), t=t) for t in ("a/Makefile", "x/y.TS", "noext")] == ["makefile", "ts", ""]
        assert text.language_filter("all") is None and text.language_filter("systems,ruby") >= {"rs", "rb"}

    def test_penalties_and_boosts(self, spark):
        q = lit_tokens("cache")
        assert value(spark, text.topic_penalty(q, F.lit("pkg/cache_test.go"))) == 0.5
        assert value(spark, text.topic_penalty(lit_tokens("test"), F.lit("pkg/cache_test.go"))) == 0.0
        assert value(spark, text.topic_penalty(q, F.lit("README.md"))) == 0.35
        assert value(spark, text.path_token_boost(lit_tokens("cache", "store"), F.lit("src/cache_store.go"))) == pytest.approx(0.03)
        assert value(spark, text.path_proximity(F.lit("a/b/c.py"), F.lit("A/b/d.py"))) == pytest.approx(0.08)
        assert value(spark, text.path_proximity(F.lit("c.py"), F.lit("d.py"))) == 0.0

    def test_feedback_words(self, spark):
        assert value(spark, text.negative_word(F.col("t")), t="run the error handler") is None
        assert value(spark, text.negative_word(F.col("t")), t="That is WRONG and useless") == "wrong"

    def test_secret_assignment(self, spark):
        assert value(spark, F.col("t").rlike(fixed.SECRET_ASSIGNMENT), t="api-key = 'abcdefghijkl'")
        assert not value(spark, F.col("t").rlike(fixed.SECRET_ASSIGNMENT), t="token = 'short'")


class TestRetrieval:
    def test_value_ranks(self, spark):
        df = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.0), (1, 3, 0.9)], "query_id long, id long, v double")
        assert {r.id: r.r for r in retrieval.value_ranks(df, "v", "r").collect()} == {3: 1, 1: 2}

    def test_fusion_turns_the_head(self, spark):
        scored = spark.createDataFrame([(1, 1, 0.100), (1, 2, 0.105)], "query_id long, id long, score double")
        ranks = {n: spark.createDataFrame([(1, 2, 1)], f"query_id long, id long, {n} int") for n in ("bm25", "primary")}
        out = retrieval.apply_fusion(scored, retrieval.fuse(ranks, fixed.FUSION_WEIGHTS)).orderBy("rank").collect()
        assert [r.id for r in out] == [2, 1]

    def test_consensus(self, spark):
        rows = spark.createDataFrame([(1, 1, 0.100, 0, 0, 0, None), (1, 2, 0.140, 1, 1, 0, 1)], "query_id long, id long, score double, path_token int, structure int, protected int, structured_rank int")
        assert [r.id for r in retrieval.consensus(rows).orderBy("rank").collect()] == [2, 1]

    def test_tail_coverage(self, spark):
        rows = spark.createDataFrame([(1, i, i, {6: 1, 5: 2}.get(i)) for i in range(1, 7)], "query_id long, id long, rank int, lexical_rank int")
        assert [r.id for r in retrieval.tail_coverage(rows, 5).orderBy("place").collect()] == [1, 2, 3, 4, 6]

    def test_protected_slot(self, spark):
        rows = spark.createDataFrame([(1, 2, 1, 0.5, True), (1, 3, 2, 0.4, False), (1, 1, 3, 0.1, True)], "query_id long, id long, rank int, base double, primary boolean")
        assert [r.id for r in retrieval.protected_first(rows, 2).orderBy("place").collect()] == [1, 2]

    def test_path_diversity(self, spark):
        rows = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "a"), (1, 3, 3, "b")], "query_id long, id long, rank int, path string")
        assert [r.id for r in retrieval.diversify(rows, 2).orderBy("place").collect()] == [1, 3]
        assert [r.id for r in retrieval.diversify(rows, 3).orderBy("place").collect()] == [1, 2, 3]

    def test_bm25_prefers_the_specific(self, spark):
        c = spark.createDataFrame([(1, "cache store evict keys"), (2, "cache " + "filler words " * 30), (3, "nothing here")], "id long, text string")
        q = spark.createDataFrame([(9, "evict cache")], "query_id long, text string")
        got = {r.id: r.score for r in retrieval.bm25(q, c).collect()}
        assert got[1] > got[2] and 3 not in got
        assert retrieval.bm25(q, c.limit(0)).count() == 0

    def test_union_keeps_the_first_source(self, spark):
        s = lambda *ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids)], "query_id long, id long, ord int")
        got = retrieval.ordered_union([s(5, 6), s(6, 7), s(8)], 3).orderBy("rank").collect()
        assert [(r.id, r.source_no) for r in got] == [(5, 0), (6, 0), (7, 1)]


class TestStore:
    def test_upsert(self, spark):
        old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
        new = spark.createDataFrame([("b", "2"), ("c", "3"), ("a", "9")], "path string, content_hash string")
        got = {r.path: (r.content_hash, r.changed) for r in store.upsert(old, new, ["path"]).collect()}
        assert got == {"a": ("9", True), "b": ("2", False), "c": ("3", True)}

    def test_ignore_rules(self, spark):
        p = spark.createDataFrame([(x,) for x in ("a/en/x", "src1/y", "docs/z.md", "src2/de/k", "deep/src1/q", "src2/den")], "path string")
        got = {r.path for r in p.filter(store.ignored(F.col("path"), ["en/", "src1", "*.md", "src2/de", "# note", ""])).collect()}
        assert got == {"a/en/x", "src1/y", "docs/z.md", "src2/de/k", "deep/src1/q"}


class TestGraph:
    def test_import_resolution(self, spark):
        e = spark.createDataFrame([("tests/test_cache.py", 1, ["app/cache.py", "app/cache/__init__.py"]), ("app/x.py", 2, ["missing.py"]), ("b/y.py", 3, ["cache.py"])], "path string, line int, candidates array<string>")
        f = spark.createDataFrame([("app/cache.py",), ("tests/test_cache.py",), ("longer/app/cache.py",)], "path string")
        got = {r.path: r.target_path for r in graph.resolve_imports(e, f).collect()}
        assert got == {"tests/test_cache.py": "app/cache.py", "app/x.py": None, "b/y.py": "app/cache.py"}

    def test_affected(self, spark):
        c = spark.createDataFrame([("pkg/cache.go",)], "path string")
        f = spark.createDataFrame([("pkg/cache.go",), ("pkg/cache_test.go",), ("pkg/other.go",)], "path string")
        r = graph.related(spark.createDataFrame([("pkg/cache.go", "pkg/other.go", "importer"), ("pkg/cache.go", "pkg/cache.go", "reference")], "source_path string, path string, signal string"))
        got = [(x.path, x.confidence) for x in graph.affected(c, f, r).collect()]
        assert got == [("pkg/cache_test.go", 0.85), ("pkg/other.go", 0.60)]

    def test_neighbours_and_ranges(self, spark):
        e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a")], "src string, dst string")
        got = {(r.node, r.depth) for r in graph.neighbours(e, spark.createDataFrame([("a",)], "seed string")).collect()}
        assert got == {("b", 1), ("d", 1), ("c", 2)}
        p = spark.createDataFrame([("f", 3), ("f", 9)], "path string, line int")
        assert graph.in_ranges(p, spark.createDataFrame([("f", 1, 5)], "path string, start_line int, end_line int")).count() == 1

    def test_validation_plan(self, spark):
        f = spark.createDataFrame([("tests/test_a.py", "py"), ("a.py", "py"), ("b.go", "go"), ("c.zz", "zz")], "path string, language string")
        got = {r.language: (r.command, r.confidence) for r in graph.validation_plan(f, {"go": "make check"}).collect()}
        assert got == {"py": ("python -m pytest tests/test_a.py", 0.80), "go": ("make check", 0.92)}


class TestSources:
    def test_byte_windows(self):
        got = list(chunks.windows(b"line1\nline2\nline3\nline4\nline5\n", 12))
        assert [(a, b) for a, b, _ in got] == [(1, 2), (2, 3), (3, 4), (4, 5)]

    def test_windows_cover_the_text_and_cut_no_character(self):
        data = ("é" * 50 + "\n") * 40
        got = list(chunks.windows(data.encode(), 64))
        assert all(len(d) <= 64 and d.decode() for _, _, d in got)
        at = 0
        for _, _, d in got:
            at = max(at, data.encode().find(d, max(at - 64, 0)) + len(d))
        assert at == len(data.encode())

    @pytest.mark.parametrize("language,code", [("py", "registry = 1\n\ndef alpha():\n    return 1\n\ndef beta():\n    return 2\n"), ("js", "function alpha() {\n  return 1\n}\nfunction beta() {\n  return 2\n}\n"), ("go", "func alpha() int {\n\treturn 1\n}\nfunc beta() int {\n\treturn 2\n}\n")])
    def test_structural_chunks(self, language, code):
        got = chunks.chunks(language, code.encode(), 60)
        alpha = next(d for _, _, d in got if b"alpha" in d)
        assert b"beta" not in alpha and b"".join(d for _, _, d in got) == code.encode()

    def test_python_symbols(self):
        got = extract.symbols("py", "class Outer:\n    '''Doc.'''\n    class Inner:\n        def run(self, x):\n            pass\n\nasync def top():\n    pass\n")
        assert [(s[0], s[1], s[3]) for s in got] == [("Outer", "class", 1), ("Inner", "class", 3), ("run", "method", 4), ("top", "function", 7)]
        assert got[2][2].startswith("Outer.Inner") and got[0][4] == "Doc."
        assert [s[0] for s in extract.symbols("py", "def broken(:\nclass Ok:\n")] == ["broken", "Ok"]

    @pytest.mark.parametrize(
        "language,line,name",
        [("go", "func (s *Store) Get(key string) error {", "Get"), ("js", "export const load = async (x) => {", "load"), ("ts", "export class Cache {", "Cache"), ("java", "  public static int size(String a) {", "size"), ("rs", "pub async fn run() {", "run"), ("rb", "  def self.call(x)", "call"), ("kt", "data class Item(val a: Int)", "Item"), ("php", "final class Box {", "Box"), ("swift", "public func open() {", "open")],
    )
    def test_symbols_of_other_languages(self, language, line, name):
        assert [s[0] for s in extract.symbols(language, line)] == [name]

    def test_references(self):
        got = extract.references("go", "func NewStore() {\n\tc := NewCacheStore(len(x)) // Old()\n\tprintln(c)\n}\n")
        assert [(r[0], r[1]) for r in got] == [("NewCacheStore", 2)]

    def test_imports(self):
        assert extract.imports("py", "from app.cache import Store\nimport os, sys as s\nfrom . import x\n")[0][:3] == ("app.cache", "Store", 1)
        assert [i[0] for i in extract.imports("py", "from . import x")] == ["."]
        assert [i[0] for i in extract.imports("ts", 'import { a } from "../src/cache"\nconst b = require("./b")')] == ["../src/cache", "./b"]
        assert [i[0] for i in extract.imports("go", 'import (\n\t"fmt"\n\tx "a/b"\n)\nvar y = "no"')] == ["fmt", "a/b"]
        assert [i[0] for i in extract.imports("html", '<script src="a.js"></script><link rel="x" href="b.css">')] == ["a.js", "b.css"]
        assert extract.candidates("ts", "tests/cache.test.ts", "../src/cache")[1] == "src/cache.ts"
        assert extract.candidates("py", "pkg/a/b.py", "..c") == ["pkg/c.py", "pkg/c/__init__.py"]

    def test_index_of_a_folder(self, spark, tmp_path):
        for path, body in {"app/cache.py": "class CacheStore:\n    def evict(self):\n        pass\n", "tests/test_cache.py": "from app.cache import CacheStore\n\ndef test_evict():\n    build(CacheStore)\n", "node_modules/x.js": "var a", "big.py": "#" * 2000, "bin.py": "a\0b", "skip/me.py": "x = 1", "settings.yaml": "a: 1"}.items():
            (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / path).write_text(body)
        o = files.Options(ignore=["skip/"], max_file_bytes=1500)
        found = files.crawl(spark, f"file://{tmp_path}", o)
        assert {r.path for r in found.collect()} == {"app/cache.py", "tests/test_cache.py", "settings.yaml"}
        index = files.build(found.persist(), o)
        index.save(f"file://{tmp_path}/.index")
        index = files.Index.load(spark, f"file://{tmp_path}/.index")
        assert {r["table"]: r.n for r in index.stats().collect()}["knowledge"] == 3
        assert index.imports.head().target_path == "app/cache.py"
        assert {"symbol", "test", "config", "import"} <= {r.kind for r in index.cards.collect()}
        found.unpersist()
        (tmp_path / "app/cache.py").unlink()
        (tmp_path / "app/new.py").write_text("def fresh():\n    pass\n")
        again = files.refresh(index, files.crawl(spark, f"file://{tmp_path}", o), o)
        assert {r.path for r in again.knowledge.collect()} == {"app/new.py", "tests/test_cache.py", "settings.yaml"}


class TestFailure:
    OUT = 'Traceback:\n  File "app/util.py", line 12, in parse_url\n    x\nNameError: name \'cache_key\' is not defined\n    at Object.run (src/main.js:4:2)\nmain.(*Store).Get(0x1)\n\t/go/src/store.go:33 +0x1\n'

    def test_frames(self, spark):
        f = spark.createDataFrame([(1, self.OUT)], "failure_id long, output string")
        got = {(r.path, r.line_no, r.function) for r in failure.frames(f).collect()}
        assert {("app/util.py", 12, "parse_url"), ("src/main.js", 4, "run"), ("go/src/store.go", 33, "Get")} <= got
        terms = failure.terms(f).head().terms
        assert {"parse_url", "cache_key", "NameError"} <= set(terms) and len(terms) <= failure.MAX_TERMS

    def test_located_and_ranked(self, spark):
        f = failure.frames(spark.createDataFrame([(1, self.OUT)], "failure_id long, output string"))
        k = spark.createDataFrame([("lib/app/util.py", 1, 10), ("lib/app/util.py", 11, 20), ("other/util.py", 1, 90)], "path string, start_line int, end_line int")
        got = failure.located(f, k).filter("function = 'parse_url'").head()
        assert (got.path, got.start_line) == ("lib/app/util.py", 11)
        s = spark.createDataFrame([("parse_url", "function", "app/util.py", 10), ("test_parse_url", "function", "tests/test_util.py", 3)], "name string, kind string, path string, line int")
        r = {x.name: x.score for x in failure.symbol_rank(failure.terms(spark.createDataFrame([(1, self.OUT)], "failure_id long, output string")), s, f).collect()}
        assert r["parse_url"] > r["test_parse_url"]


class TestPacks:
    def rows(self, spark):
        c = spark.createDataFrame([(1, 1, 1, "app/cache.py", "cache", "class CacheStore evict keys\n" * 50, 0.1), (1, 2, 2, "noise.py", "n", "plain filler", 0.9)], "query_id long, id long, rank int, path string, topic string, text string, score double")
        return packs.receipts(c, spark.createDataFrame([(1, "evict keys in cachestore")], "query_id long, text string"))

    def test_weak_tail_is_left_out_and_budget_kept(self, spark):
        got = packs.pack(self.rows(spark), 4, 900).collect()
        assert [r.id for r in got] == [1] and got[0].truncated and got[0].used_bytes <= 900

    def test_quality(self, spark):
        r = spark.createDataFrame([(1, "a.py", 2, 1, 1, True, False), (1, "tests/t.py", 2, 1, 1, True, False)], "query_id long, path string, evidence int, definitions int, references int, receipt boolean, truncated boolean")
        got = packs.quality(r).head()
        assert got.score == 1.0 or got.score > 0.9 and got.grade == "strong"

    def test_small_functions(self, spark):
        assert packs.limit_of(0) == 5 and packs.limit_of(999) == 100 and packs.budget_of(1) == packs.LEAST
        assert packs.expand_mode("error in cache", "debug").startswith("error in cache failure")
        assert value(spark, packs.cut(F.col("t"), F.lit(4)), t="aé" * 10) == "aéa"


class TestEvaluate:
    def test_metrics(self, spark):
        tops = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1), (2, 9, 2)], "query_id long, id long, rank int")
        gold = spark.createDataFrame([(1, 8), (2, 5), (3, 1)], "query_id long, gold long")
        got = {r.query_id: (r.gold_rank, r.rr, r.hit3, r.dup) for r in evaluate.per_case(tops, gold).collect()}
        assert got == {1: (2, 0.5, True, 0), 2: (None, 0.0, False, 1), 3: (None, 0.0, False, 0)}

    def test_tuning_finds_the_feature(self, spark):
        rows = [(q, i, float(i == q % 3), 0.5 * (i == 0)) for q in range(9) for i in range(3)]
        c = spark.createDataFrame(rows, "query_id long, id long, good double, bad double")
        gold = spark.createDataFrame([(q, q % 3) for q in range(9)], "query_id long, gold long")
        w, m = evaluate.tune(c, gold, ["good", "bad"], {"good": 0.0, "bad": 1.0}, [0.0, 1.0, 2.0])
        assert m["acc1"] == 1.0 and w["good"] > 0

    def test_perceptron_and_verdict(self):
        import numpy as np

        w = evaluate.perceptron([(np.array([[1.0, 0.0], [0.0, 1.0]]), 0)] * 3, 2)
        assert w[0] > w[1]
        assert [evaluate.verdict(0.1, [0.0]), evaluate.verdict(0.0, [0.0]), evaluate.verdict(0.5, [-0.1])] == ["pass", "neutral", "hold"]


class TestDistance:
    def test_qnd(self, spark):
        c = distance.Zlib()
        assert distance.qnd_value(c, "", "x") == 1.0
        assert distance.qnd_value(c, "the same words", "the same words") < distance.qnd_value(c, "the same words", "zq9 8vb")
        assert distance.Zstd().size(b"") == 0

    def test_lcs(self):
        assert distance.lcs_length(list("abcbdab"), list("bdcaba")) == 4


class TestStreaming:
    def test_upserts_over_batches(self, spark, tmp_path):
        for k, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2)])):
            spark.createDataFrame(rows, "key string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/t.parquet")
            sink = incremental.Upserts(spark, f"{tmp_path}/out", ["key"], "key string, n long") if not k else sink  # noqa: F821
            s = incremental.table_stream(spark, f"{tmp_path}/in", "t")
            incremental.drain(s, f"{tmp_path}/check", sink, "append")
        assert {r.key: r.n for r in sink.table().collect()} == {"a": 2, "b": 1}

    def test_throttle(self):
        assert [incremental.should_sync(None, 0), incremental.should_sync(0, 1), incremental.should_sync(0, 31)] == [True, False, True]

