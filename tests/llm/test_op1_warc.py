import base64
import hashlib

import pytest

from quarry.llm import op1_warc as W
from quarry.llm.common import filesystem


def brute(rows, least=0):
    best = {}
    for i, _, h in rows:
        p = (h or "").encode()
        best[p] = max([x for x in (best.get(p), i) if x is not None], default=None)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = len(p) < least or best[p] == i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else best[p]))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "x" * 50), (2, "http://b/ c\r\n", "x" * 50), (3, None, None), (4, "u", ""), (5, "u", "é" * 3000), (5, "u", "é" * 3000), (None, "u", "alone"), (None, "v", "x" * 50), (9, "w", "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as n", "2 as sha1")
    got = W.read(W.archive(pages, min_bytes=least)).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(ROWS, least)
    kept = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert kept[5] == "é" * 3000 and kept[9] == ROWS[-1][2]


def test_empty_table(spark):
    assert W.read(W.archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_parts_begin_with_their_dictionary_and_frames_stand_alone(tmp_path):
    w = W.PartWriter(f"file://{tmp_path}/a")
    data = [W.record(i, f"http://h/{i}", (f"<html><body>common words of page {i} " * 20).encode(), hashlib.sha1(str(i).encode()).hexdigest(), None) for i in range(500)]
    for d in data:
        w.add(d)
    ((path, n, size),) = w.close()
    raw = open(path, "rb").read()
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and n == 500
    fs, _ = filesystem(f"file://{tmp_path}")
    with fs.open_input_stream(path, compression=None) as s:
        assert list(W.frames(s)) == data
    assert size < sum(map(len, data)) / 5


def test_few_records_have_no_dictionary_but_read(tmp_path):
    w = W.PartWriter(f"file://{tmp_path}/b")
    w.add(W.record(1, "u", b"x", "00" * 20, None))
    ((path, _, _),) = w.close()
    fs, _ = filesystem(f"file://{tmp_path}")
    with fs.open_input_stream(path, compression=None) as s:
        assert len(list(W.frames(s))) == 1


def test_cut_record_is_an_error(tmp_path):
    w = W.PartWriter(f"file://{tmp_path}/c")
    w.add(W.record(1, "u", b"x" * 1000, "00" * 20, None))
    ((path, _, _),) = w.close()
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:-3])
    fs, _ = filesystem(f"file://{tmp_path}")
    with pytest.raises(Exception), fs.open_input_stream(path, compression=None) as s:
        list(W.frames(s))
