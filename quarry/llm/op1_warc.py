"""WARC archives with a Zstandard dictionary per archive part.

Each part begins with a skippable frame (magic 0x184D2A5D) that holds a
dictionary trained on the part's first records; every record is a frame of its
own, so a record can be read by offset.  A part has at most PART_BYTES of
compressed records; its dictionary comes from at most SAMPLE_RECORDS records.

Parts are named afresh by each task attempt, and only those in the manifest,
which Spark commits task by task, are read: a lost executor or a second attempt
leaves at most an unlisted file.

Cases: html null counts as empty; url null is written as urn:x-none:; page_id
null is kept (it ranks below every number); repeated rows that share page_id and
payload are each the response; columns besides the three are not read.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, pick, table, text_slices, written

SKIPPABLE = 0x184D2A5D
DICT_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, PART_BYTES, LEVEL = 64 << 10, 400, 4 << 20, 64 << 20, 3
_ID = "urn:x-page:"


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, sha1 and refers_to: the largest page_id of an equal payload, if another's.

    Only one row per digest and map task is shuffled for the winners.  They are
    written, so that the wide join on the digest has an exchange on either side
    and AQE can split a hot payload.
    """
    p = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("sha1", F.sha1("html"))
    win = p.groupBy(F.col("sha1").alias("w_sha1")).agg(F.max("page_id").alias("w_id"), F.count("*").alias("n")).filter("n > 1")
    win = written(win, "winners")
    own = F.octet_length("html") >= min_bytes
    return p.join(win, F.col("sha1") == F.col("w_sha1"), "left").select(
        "page_id", "url", "html", "sha1", F.when(own & F.col("w_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("w_id")), F.col("w_id")).alias("refers_to")
    )


def record(page_id, url, payload: bytes, sha1: str, refers_to) -> bytes:
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:x-none:"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: {digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on the samples; None where they are too few or too small for training."""
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    while len(samples) >= 8 and size >= 256:
        try:
            return zstandard.train_dictionary(size, samples)
        except zstandard.ZstdError:  # samples too much alike for so large a dictionary
            size = size * 3 // 4
    return None


class PartWriter:
    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path, recursive=True)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.out = self.compress = None
        self.done: list[tuple[str, int, int]] = []

    def add(self, data: bytes) -> None:
        if self.compress is None:
            self.held.append(data)
            self.held_bytes += len(data)
            if len(self.held) >= SAMPLE_RECORDS or self.held_bytes >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(data)

    def _begin(self) -> None:
        self.dict = dictionary(self.held)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=self.dict) if self.dict else zstandard.ZstdCompressor(level=LEVEL)
        held, self.held = self.held, []
        for x in held:
            self._put(x)

    def _put(self, data: bytes) -> None:
        if self.out is None:
            import uuid

            self.name, self.n, self.size = f"{self.path}/{uuid.uuid4().hex}.warc.zst", 0, 0
            self.out = self.fs.open_output_stream(self.name, compression=None)
            if self.dict:
                raw = self.dict.as_bytes()
                self.size += self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw) or 0
        frame = self.compress.compress(data)
        self.out.write(frame)
        self.n += 1
        self.size += len(frame)
        if self.size >= PART_BYTES:
            self._end()

    def _end(self) -> None:
        self.out.close()
        self.done.append((self.name, self.n, self.size))
        self.out = None

    def close(self) -> list[tuple[str, int, int]]:
        if self.held:
            self._begin()
        if self.out is not None:
            self._end()
        return self.done


def write(planned: DataFrame, uri: str) -> DataFrame:
    """Writes the archives; the manifest: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = PartWriter(uri)
        for b in text_slices(batches, "html"):
            for r in zip(*(b.column(i).to_pylist() for i in range(5))):
                writer.add(record(r[0], r[1], r[2].encode(), r[3], r[4]))
        done = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return written(planned.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


def frames(stream) -> Iterator[bytes]:
    """The records of a part, one by one, with bounded memory."""
    head = stream.read(8)
    dict_data = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        dict_data = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0]))
        head = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dict_data) if dict_data else zstandard.ZstdDecompressor()
    rest, ended = head, False
    while True:
        if not rest:
            rest = b"" if ended else stream.read(1 << 20)
            if not rest:
                return
        one, out = decompressor.decompressobj(), []
        while True:
            out.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(1 << 20)
            if not rest:
                raise ValueError("a record is cut off")
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of a WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read(manifest: DataFrame) -> DataFrame:
    """The records of the listed archives: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    Payload digests of responses are computed anew and must agree with the header.
    """
    import hashlib

    schema = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(x: str | None):
        x = (x or "none").strip("<>").removeprefix(_ID)
        return None if x == "none" else int(x)

    def rows(paths) -> Iterator[tuple]:
        for path in paths:
            fs, _ = filesystem(home)
            with fs.open_input_stream(path, compression=None) as stream:
                for data in frames(stream):
                    fields, block = parse(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest, response = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "response"
                    if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"a payload in {path} is not what its header says")
                    yield number(fields["warc-record-id"]), fields["warc-target-uri"], payload if response else None, size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))

    home = manifest.home

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], names)
        for b in batches:
            for r in rows(b.column(0).to_pylist()):
                held.append(r)
                size += len(r[2] or b"") + 100
                if size > 4 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    n = max(1, min(manifest.sparkSession.sparkContext.defaultParallelism * 4, 10_000))
    return manifest.table.repartition(n, "path").select("path").mapInArrow(run, schema)


class Manifest:
    """Where the archives lie, and the table of those that count."""

    def __init__(self, home: str, table: DataFrame):
        self.home, self.table, self.sparkSession = home, table, table.sparkSession


def archive(pages: DataFrame, uri: str | None = None, min_bytes: int = 0) -> Manifest:
    uri = uri or fresh_dir(pages.sparkSession, "warc")
    return Manifest(uri, write(plan(pages, min_bytes), uri))


def query(spark, sf_dir) -> DataFrame:
    out = read(archive(table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc_dictionary_writer": query}
#: Base32 of a 20-byte digest: 32 groups of five bits.
SQL = {
    "op1_warc_dictionary_writer": """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) s from pages),
w as (select s, max(page_id) m from p group by s),
d as (select p.page_id, strlen(h)::bigint b, m,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     (('0x' || substr('0' || p.s || '0', (5 * i) // 4 + 2, 2))::int // (case (5 * i) % 4 when 0 then 8 when 1 then 4 when 2 then 2 else 1 end)) % 32 + 1, 1), '' order by i)
   from range(0, 32) t(i)) g
  from p join w using (s))
select page_id, b payload_bytes, g payload_digest, case when page_id is not distinct from m then 'response' else 'revisit' end record_type,
  case when page_id is not distinct from m then null else m end refers_to from d"""
}
