"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Writing and reading go through Spark's text source, so any store that Spark reaches will do and no
Python worker opens a file. The writer's rows are runs of whole members; the separator that the text
writer puts after a row is an empty gzip member, so a file is nothing but members. The reader takes the
gzip magic as the separator: each task scans its byte range of a file for it and owns the stretches
that start inside, and a stretch is a candidate member. A candidate is validated by decoding its gzip
header, its deflate stream and the start of a WARC header; where the magic occurs by chance inside
a member, the stretches are joined until the member's checksum is met. What such a member leaves beyond
the end of its task's range is joined in order of the byte boundaries in a second, small step.

Equal payloads: of records whose payload has at least ``least_bytes`` bytes, the one with the largest
page_id is a response, the others are revisits that refer to it and hold no payload.

Defined cases: a null html is an empty payload; a null url is an empty URI; blanks and controls in a URI
are percent-encoded; a null page_id is kept (it is a response only if no other page has its payload and
an id); rows that repeat the largest page_id are responses each; an empty table gives an empty archive;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimward.llm.common import new_path, stage

MAGIC = b"\x1f\x8b\x08"
RUN_BYTES = 1 << 20


def member(data: bytes) -> bytes:
    """One gzip member with a fixed header."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    return MAGIC + b"\0\0\0\0\0\0\xff" + deflate.compress(data) + deflate.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % ("none" if page_id is None else str(page_id)).encode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _urn(page_id),
        b"WARC-Target-URI: " + _uri(url),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + sha1.encode(),
        *([b"WARC-Refers-To: " + _urn(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, size = [], 0
    for batch in batches:
        for page_id, url, payload, sha1, refers_to, revisit in zip(*(batch[c] for c in ("page_id", "url", "payload", "sha1", "refers_to", "revisit")), strict=True):
            body = payload.as_py()
            run.append(member(record(page_id.as_py(), url.as_py(), body, base64.b32encode(bytes.fromhex(sha1.as_py())).decode(), refers_to.as_py(), revisit.as_py())))
            size += len(run[-1])
            if size >= RUN_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(run)], pa.binary())], ["run"])
                run, size = [], 0
    if run:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(run)], pa.binary())], ["run"])


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> str:
    """Writes a record for each page; gives the archives' folder."""
    path = path or new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("_first"))
    marked = rows.join(first, "sha1", "left")
    small = F.octet_length("payload") < least_bytes
    revisit = ~(small | F.col("page_id").eqNullSafe(F.col("_first")))
    marked = marked.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))
    runs = marked.mapInArrow(_write, "run binary").select(F.col("run").cast("string").alias("value"))
    runs.write.option("lineSep", member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return path


class Member:
    """A gzip member that is decoded piece by piece."""

    def __init__(self):
        self.raw: list[bytes] = []
        self.out: list[bytes] = []
        self.inflate = zlib.decompressobj(31)

    def feed(self, data: bytes) -> str:
        """'whole', 'open' or 'bad'."""
        self.raw.append(data)
        try:
            self.out.append(self.inflate.decompress(data))
        except zlib.error:
            return "bad"
        return "whole" if self.inflate.eof else "open"

    def data(self) -> bytes:
        return b"".join(self.out)


def start_member(stretch: bytes) -> tuple[str, Member]:
    """A candidate's state: its gzip header and what can be decoded so far must be those of a record."""
    found = Member()
    state = found.feed(MAGIC + stretch)
    if not b"WARC/".startswith(found.data()[:5]):
        state = "bad"
    return state, found


class Range:
    """The stretches of one byte range of a file, in order.

    In the first range of a file every member starts where the one before it ends. In another range, what comes
    before the first member that decodes whole may belong to the range before, and is left in ``early``.
    A damaged member fails the job or, with ``skip``, is left out, and the reader goes on at the next magic.
    """

    def __init__(self, first: bool, skip: bool = False):
        self.skip = skip
        self.early: list[bytes] = []
        self.synced, self.pending, self.start = first, None, 0

    def add(self, stretch: bytes) -> list[bytes]:
        """The members that this stretch completes."""
        if self.synced:
            if self.pending is None:
                state, self.pending = start_member(stretch)
            else:
                state = self.pending.feed(MAGIC + stretch)
            if state == "bad":
                if not self.skip:
                    raise ValueError("an archive holds a damaged member")
                later, self.pending = self.pending.raw[1:], None
                return [x for y in later for x in self.add(y.removeprefix(MAGIC))]
            return self._whole() if state == "whole" else []
        self.early.append(stretch)
        while self.start < len(self.early):
            if self.pending is None:
                state, self.pending = start_member(self.early[self.start])
                for more in self.early[self.start + 1 :] if state == "open" else ():
                    if (state := self.pending.feed(MAGIC + more)) != "open":
                        break
            else:
                state = self.pending.feed(MAGIC + stretch)
            if state == "open":
                return []
            if state == "whole":
                rest = self.early[self.start + len(self.pending.raw) :]
                self.early, self.synced = self.early[: self.start], True
                return self._whole() + [x for y in rest for x in self.add(y)]
            self.start, self.pending = self.start + 1, None
        return []

    def _whole(self) -> list[bytes]:
        data, self.pending = self.pending.data(), None
        return [data]

    def parts(self) -> list[tuple[int, bytes]]:
        """What other ranges are needed for: (0, the open end) if this range is synchronised, and its early stretches."""
        early = [(n, MAGIC + x) for n, x in enumerate(self.early, 1)]
        return early + ([(0, b"".join(self.pending.raw))] if self.synced and self.pending is not None else [])


_ID = re.compile(r"<urn:page:(-?\d+)>")


def parse(data: bytes, payload: bool) -> tuple | None:
    """(record_id, page_id, record_type, uri, refers_to, payload, payload_bytes, payload_digest), or None for the empty member."""
    if not data:
        return None
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    if not fields.get(b"content-length", "").isdigit() or b"warc-type" not in fields:
        raise ValueError("a record lacks its type or length")
    block = rest[: int(fields[b"content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    kind = fields[b"warc-type"]
    stated = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        sha1, size = stated, int(length[1]) if length else None
    else:
        sha1, size = digest(body), len(body)
        if stated and stated != sha1:
            raise ValueError(f"payload digest of {fields.get(b'warc-record-id')} does not match")
    as_id = lambda x: int(m[1]) if (m := _ID.fullmatch(x or "")) else None
    name = fields.get(b"warc-record-id")
    return name, as_id(name), kind, fields.get(b"warc-target-uri"), as_id(fields.get(b"warc-refers-to")), body if payload and kind != "revisit" else None, size, sha1


def records(members: list[bytes], payload: bool, skip: bool) -> Iterator[tuple]:
    """The records of whole members; one that cannot be parsed fails the job or, with ``skip``, is left out."""
    for data in members:
        try:
            if found := parse(data, payload):
                yield found
        except ValueError:
            if not skip:
                raise


RECORD = [("record_id", "string", pa.string()), ("page_id", "long", pa.int64()), ("record_type", "string", pa.string()), ("uri", "string", pa.string()), ("refers_to", "long", pa.int64()), ("payload", "binary", pa.binary()), ("payload_bytes", "long", pa.int64()), ("payload_digest", "string", pa.string())]
PART = [("part_file", "string", pa.string()), ("part_boundary", "long", pa.int64()), ("part_no", "int", pa.int32()), ("part", "binary", pa.binary())]
COLUMNS = [c[0] for c in RECORD]


def _scan(payload: bool, skip: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, out, size = None, None, [], 0
        none = (None,) * len(RECORD)

        def close():
            for n, data in now.parts():
                out.append((*none, at[0], at[1] + (0 if n else at[2]), n, data))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t[2]) for c, t in zip(zip(*rows, strict=True), RECORD + PART, strict=True)], [t[0] for t in RECORD + PART])

        for batch in batches:
            for stretch, *where in zip(batch["stretch"], batch["file"].to_pylist(), batch["start"].to_pylist(), batch["length"].to_pylist(), strict=True):
                if where != at:
                    if now:
                        close()
                    at, now = where, Range(where[1] == 0, skip)
                    if where[1] == 0:  # before the first magic of a file
                        continue
                for found in records(now.add(stretch.as_py() or b""), payload, skip):
                    out.append((*found, None, None, None, None))
                    size += len(found[5] or b"") + 200
                if size > 4_000_000:
                    yield batch_of(out)
                    out, size = [], 0
        if now:
            close()
        if out:
            yield batch_of(out)

    return run


def _join_parts(payload: bool, skip: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch["parts"].to_pylist():
                # the open end of a range, then what the ranges after it could not place
                reader = Range(True, skip)
                rows += [x for p in parts for x in records(reader.add(p["part"].removeprefix(MAGIC)), payload, skip)]
                if reader.pending is not None and not skip:
                    raise ValueError("an archive ends inside a record")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t[2]) for i, t in enumerate(RECORD)], COLUMNS)

    return run


def read_archives(spark: SparkSession, path: str, payload: bool = True, on_damage: str = "fail") -> DataFrame:
    """The records below ``path``: record_id, page_id, record_type, uri, refers_to, payload (null for
    revisits or if not asked for), payload_bytes and payload_digest of the full payload. A damaged member or record
    fails the job; with ``on_damage="skip"`` it is left out and all others are read."""
    if on_damage not in ("fail", "skip"):
        raise ValueError("on_damage is 'fail' or 'skip'")
    skip = on_damage == "skip"
    text = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    stretches = text.select(F.col("value").cast("binary").alias("stretch"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"))
    scanned = stretches.mapInArrow(_scan(payload, skip), ", ".join(f"{n} {t}" for n, t, _ in RECORD + PART))
    if not payload:
        scanned = stage(scanned, "warc-records")
    order = Window.partitionBy("part_file").orderBy("part_boundary", "part_no")
    parts = scanned.where("part is not null").withColumn("_open", F.sum(F.when(F.col("part_no") == 0, 1).otherwise(0)).over(order))
    parts = parts.groupBy("part_file", "_open").agg(F.sort_array(F.collect_list(F.struct("part_boundary", "part_no", "part"))).alias("parts"))
    joined = parts.select("parts").mapInArrow(_join_parts(payload, skip), ", ".join(f"{n} {t}" for n, t, _ in RECORD))
    return scanned.where("part is null").select(*COLUMNS).unionByName(joined)


def round_trip(pages: DataFrame, least_bytes: int = 0, payload: bool = False) -> DataFrame:
    """The pages written as archives and read back."""
    return read_archives(pages.sparkSession, write_archives(pages, None, least_bytes), payload)
