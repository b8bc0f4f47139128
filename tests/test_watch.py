"""The watch loop: what a batch writes, restarts, passes that come again."""

import os

import pytest

from quarry.sources import files
from quarry.streaming.watch import DELTA, Watch


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a.py").write_text("def a():\n    pass\n")
    (root / "sub/b.go").write_text("package b\n")
    (root / "odd [1].py").write_text("x = 1\n")
    return root


def watch(spark, tmp_path):
    return Watch(spark, f"file://{tmp_path}/root", f"file://{tmp_path}/home", files.Options())


def contents(w):
    return {r.path: r.content for r in w.table().collect()}


def written(tmp_path):
    """Paths of the rows that each batch wrote."""
    import pyarrow.parquet as pq

    out = {}
    for d in sorted((tmp_path / "home/rows").iterdir()):
        out[int(d.name[6:])] = sorted(p for f in d.glob("*.parquet") for p in pq.ParquetFile(f).read(["path"]).column(0).to_pylist())
    return out


def test_a_batch_writes_what_changed_only_also_after_a_restart(spark, tmp_path, folder):
    w = watch(spark, tmp_path)
    w.once()
    assert set(contents(w)) == {"a.py", "sub/b.go", "odd [1].py"}
    w.once()  # nothing has changed
    assert len(written(tmp_path)) == 1
    (folder / "odd [1].py").write_text("x = 2000\n")
    w = watch(spark, tmp_path)  # another process, the same home
    w.once()
    assert list(written(tmp_path).values())[1:] == [["odd [1].py"]]
    assert contents(w)["odd [1].py"] == "x = 2000\n" and len(contents(w)) == 3
    os.remove(folder / "a.py")
    (folder / "c.js").write_text("let c\n")
    w.once()
    assert set(contents(w)) == {"sub/b.go", "odd [1].py", "c.js"}
    assert list(written(tmp_path).values())[2:] == [["c.js"]]
    (folder / "a.py").write_text("back = 1\n")
    watch(spark, tmp_path).once()
    log = [(r.path, r.status) for r in w.log().orderBy("batch", "path").collect()]
    assert log[3:] == [("odd [1].py", "changed"), ("a.py", "deleted"), ("c.js", "new"), ("a.py", "new")]
    assert contents(w)["a.py"] == "back = 1\n"


def test_several_passes_in_one_batch_and_a_batch_again(spark, tmp_path, folder):
    w = watch(spark, tmp_path)
    w.look()
    (folder / "a.py").write_text("changed = 1\n")
    w.look()
    os.remove(folder / "sub/b.go")
    w.look()
    w.drain()
    assert contents(w) == {"a.py": "changed = 1\n", "odd [1].py": "x = 1\n"}
    before = contents(w)
    again = w.log().select("path", "status", "stamp", "look").collect()
    w._write(w.spark.createDataFrame(again, DELTA), 0)
    assert contents(w) == before


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "root").mkdir()
    w = watch(spark, tmp_path)
    w.once()
    assert contents(w) == {} and w.log().count() == 0
    (tmp_path / "root/a.py").write_text("a = 1\n")
    w.once()
    (tmp_path / "root/a.py").unlink()
    w.once()
    assert contents(w) == {}
