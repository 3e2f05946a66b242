import base64
import collections
import gzip
import hashlib
import random

import pytest

from rimward.llm import warc

PAGES = "page_id long, url string, html string, record_type string"


def rows():
    rng = random.Random(2)
    out = [(i, f"http://x/{i} {i}\r\n", rng.choice(["", "same", "<p>é漢</p>", f"<html>{i}" + "z" * rng.randrange(3000)]), "clash") for i in range(80)]
    out += [(200, None, None, None), (201, "u", "y" * 300_000, ""), (None, "u", "same", ""), (None, "u", "only without an id", ""), (79, "again", out[79][2], "")]
    return out


def wanted(pages, least=0):
    first = {}
    for i, _, html, _ in pages:
        if i is not None:
            first[html or ""] = max(i, first.get(html or "", i))
    out = collections.Counter()
    for i, _, html, _ in pages:
        data = (html or "").encode()
        top = first.get(html or "")
        revisit = len(data) >= least and i != top
        out[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None)] += 1
    return out


def got(df):
    return collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


def test_round_trip_and_payloads(spark):
    pages = spark.createDataFrame(rows(), PAGES).repartition(3)
    assert got(warc.round_trip(pages)) == wanted(rows())
    assert got(warc.round_trip(pages, least_bytes=5)) == wanted(rows(), 5)
    found = warc.round_trip(pages, payload=True).where("record_type = 'response'").collect()
    html = {r[0]: r[2] or "" for r in rows()}
    assert all(r["payload"].decode() == html[r["page_id"]] for r in found if r["page_id"] is not None)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_files_are_plain_gzip(spark, tmp_path):
    path = warc.write_archives(spark.createDataFrame(rows(), PAGES).coalesce(1), str(tmp_path / "w"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part*"))
    assert path and text.count(b"WARC/1.1\r\n") == len(rows())


def test_damaged_members_are_skipped_or_fail(spark, tmp_path):
    rng = random.Random(8)
    good = {i: bytes(rng.randrange(256) for _ in range(300)) for i in range(30)}
    members = [warc.member(warc.record(i, "u", p, warc.digest(p), None, False)) for i, p in good.items()]
    broken = bytearray(members[7])
    broken[40] ^= 255
    members[7] = bytes(broken)
    members[12] = members[12][:60]  # cut off
    members[20] = warc.member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length")
    (tmp_path / "a.warc").write_bytes(b"".join(members))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (211, 1500, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            found = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, str(tmp_path / "a.warc"), on_damage="skip").collect()}
            assert found == {i: p for i, p in good.items() if i not in (7, 12, 20)}, size
            with pytest.raises(Exception, match="damaged|lacks|inside"):
                warc.read_archives(spark, str(tmp_path / "a.warc")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_ranges_and_chance_magics(spark, tmp_path):
    """A stored deflate block keeps the payload as it is, with the magic in it, so ranges cut members in odd places."""
    rng = random.Random(4)
    data, want = b"", {}
    for i in range(40):
        payload = b"".join(rng.choice([b"\x1f\x8b\x08", b"abc", bytes([rng.randrange(256)])]) for _ in range(rng.randrange(400)))
        body = warc.record(i, "u", payload, warc.digest(payload), None, False)
        want[i] = payload
        stored = b"\x01" + len(body).to_bytes(2, "little") + (len(body) ^ 0xFFFF).to_bytes(2, "little") + body
        data += warc.MAGIC + b"\0\0\0\0\0\0\xff" + stored + warc.zlib.crc32(body).to_bytes(4, "little") + len(body).to_bytes(4, "little")
    (tmp_path / "a.warc").write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (97, 512, 4096, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            found = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, str(tmp_path / "a.warc")).collect()}
            assert found == want, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
