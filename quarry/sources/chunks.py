"""Chunkers: byte windows with overlap, and structure-aware blocks of code."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import scan

MAX_BYTES, OVERLAP = 64 << 10, 0.2


def _boundary(data: bytes, at: int) -> int:
    """The start of the code point that `at` lies in."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _lines(chunk: bytes) -> int:
    return max(1, chunk.count(b"\n") + (not chunk.endswith(b"\n")))


def windows(data: bytes, most: int = MAX_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(first line, last line, bytes).  A window ends after its last line break, if that lies beyond its half; a fifth overlaps; no code point is cut."""
    most = max(most, 8)
    at, line, size = 0, 1, len(data)
    while True:
        end = at + most
        if end >= size:
            yield line, line + _lines(data[at:]) - 1, data[at:]
            return
        end = _boundary(data, end)
        cut = data.rfind(b"\n", at, end)
        if cut - at > most // 2:
            end = cut + 1
        yield line, line + _lines(data[at:end]) - 1, data[at:end]
        following = _boundary(data, end - int(most * OVERLAP))
        following = following if following > at else end
        line += data.count(b"\n", at, following)
        at = following


def spans(language: str, data: bytes) -> list[tuple[int, int]]:
    """(first line, last line) of top-level items; none where the text can't be read."""
    if language == "py":
        try:
            body = ast.parse(data).body
            return [(min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]), n.end_lineno) for n in body]
        except (SyntaxError, ValueError, RecursionError):
            pass
    if language not in scan.RULES:
        return []
    try:
        return scan.spans(language, data.decode(errors="replace"))
    except scan.Unreadable:
        return []


def chunks(language: str, data: bytes, most: int = MAX_BYTES) -> list[tuple[int, int, bytes]]:
    """One chunk if it fits; else top-level items, each with what is between it and the one before, packed up to `most`; those that
    don't fit fall to windows."""
    if len(data) <= most:
        return [(1, _lines(data), data)]
    found = spans(language, data)
    if not found:
        return list(windows(data, most))
    lines = [x + b"\n" for x in data.split(b"\n")]
    lines[-1] = lines[-1][:-1]
    edges = sorted({0, *(b for _, b in found if b < len(lines)), len(lines)})
    out: list[tuple[int, int, bytes]] = []
    for a, b in zip(edges, edges[1:]):
        block = b"".join(lines[a:b])
        if not block:
            continue
        if len(block) > most:
            out += [(a + x, a + y, d) for x, y, d in windows(block, most)]
        else:
            out.append((a + 1, b, block))
    packed = out[:1]
    for x, y, d in out[1:]:
        px, py, pd = packed[-1]
        if len(pd) + len(d) <= most and py + 1 == x:
            packed[-1] = (px, y, pd + d)
        else:
            packed.append((x, y, d))
    return packed


def chunk(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """S17.  files: path, language, content string.  A row for each chunk: topic has #chunk-NNN where there are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, language, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = chunks(language or "", (content or "").encode(), most)
                for k, (first, last, data) in enumerate(found):
                    rows.append((path, language, path if len(found) == 1 else f"{path}#chunk-{k + 1:03d}", k, first, last, data.decode(), hashlib.sha256(data).hexdigest()))
            names = ["path", "language", "topic", "seq", "start_line", "end_line", "content", "content_hash"]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("path", "language", "content").mapInArrow(run, "path string, language string, topic string, seq int, start_line int, end_line int, content string, content_hash string")


def span_table(files: DataFrame) -> DataFrame:
    """X04.  files: path, language, content.  path, start_line, end_line: a row for each top-level item of a file that can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, *s) for path, language, content in zip(*(b.column(i).to_pylist() for i in range(3))) for s in spans(language or "", (content or "").encode())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32()))], ["path", "start_line", "end_line"])

    return files.select("path", "language", "content").mapInArrow(run, "path string, start_line int, end_line int")
