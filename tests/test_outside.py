"""Commands and rerankers outside of Spark."""

import shlex
import subprocess
import sys

import pytest

from quarry.operators import outside


def _python(code):
    return f"{shlex.quote(sys.executable)} -c {shlex.quote(code)}"


def test_run():
    ran = outside.run(_python("import sys; print('out'); print('err', file=sys.stderr); sys.exit(3)"))
    assert (ran.code, ran.passed, sorted(ran.output.split())) == (3, False, ["err", "out"])
    assert outside.run(_python("pass")).passed
    assert outside.run("no-such-command-here").code == 127
    assert outside.run("'unbalanced").code == 127
    assert outside.run(_python("import time; time.sleep(30)"), seconds=0.5).code == 124


@pytest.fixture
def found(spark):
    return spark.createDataFrame([(7, "a", "x", 1), (8, "b", "y", 2), (9, "c", "z", 3)], "id long, path string, text string, rank int")


def test_rerank_by_command(found):
    """Unknown and repeated ids of the answer don't count, what it leaves out follows as it was."""
    code = "import json, sys; s = json.load(sys.stdin)['snippets']; print(json.dumps({'ids': [s[2]['id'], 'other', s[2]['id']]}))"
    rows = outside.by_command(_python(code), "query")(found).orderBy("place").collect()
    assert [(r["id"], r["place"]) for r in rows] == [(9, 1), (7, 2), (8, 3)]


def test_rerank_fails_as_the_command_does(found):
    with pytest.raises(subprocess.CalledProcessError):
        outside.by_command(_python("raise SystemExit(2)"))(found)


def test_rerankers_by_url_and_answers_that_are_none(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    import pytest

    class Answer(BaseHTTPRequestHandler):
        said = None

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = self.said or json.dumps([{"id": s["id"]} for s in reversed(asked["snippets"])]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/"
        found = spark.createDataFrame([(k, f"p{k}", f"text {k}", k) for k in (1, 2, 3)], "id long, path string, text string, rank int")
        assert {r.id: r.place for r in outside.by_url(url, "q")(found).collect()} == {3: 1, 2: 2, 1: 3}
        Answer.said = b"<html>no"
        with pytest.raises(ValueError, match="127.0.0.1"):
            outside.by_url(url)(found)
    finally:
        server.shutdown()
    with pytest.raises(ValueError, match="echo"):
        outside.by_command("echo hello")(found)


def test_cards_can_be_left_out(spark, monkeypatch):
    from quarry.sources import files

    rows = spark.createDataFrame([("a.py", "py", "def f():\n    g()\n", 10, 1)], "path string, language string, content string, size long, mtime long")
    assert files.build(rows).cards.count() > 0 and files.build(rows, files.Options(cards=False)).cards.count() == 0
    monkeypatch.setenv("QUARRY_CARDS", "0")
    assert not files.Options().cards


def test_a_newest_row_is_named_where_it_is_not_plain(spark, tmp_path):
    import pytest

    from quarry.streaming.incremental import Upserts

    with pytest.raises(ValueError, match="a, b"):
        Upserts(spark, f"{tmp_path}/t", ["key"], "key string, a long, b long")
    assert Upserts(spark, f"{tmp_path}/t", ["key"], "key string, a long, b long", "b").stamp == "b"
