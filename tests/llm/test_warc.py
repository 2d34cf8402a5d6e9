"""WARC archives: round trips, splits at any byte, hostile payloads."""

import gzip
import os
import random
import tempfile
import zlib

import pytest

from loomline.llm import warc
from loomline.session import new_path

PAGE = "page_id long, url string, html string, payload string, type string, key string"


def pages_frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGE).repartition(parts)


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same, default=None) if len(data) >= least else page
        revisit = first is not None and page != first
        out.append((page, len(data), warc.base32_sha1(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def hard_rows():
    rows = [(i, f"http://h/{i}", f"<html>page {i % 7}</html>") for i in range(5, 60)]
    rows += [(100, None, None), (101, "u", ""), (99, "u\r\nX: y", ""), (None, "u", "x"), (None, "u", "x"), (None, "u", "<html>page 1</html>")]
    rows += [(200, "u", "long é漢𝄞 " * 100_000), (-3, "u", "long é漢𝄞 " * 100_000)]
    rows += [(7, "other", "<html>page 0</html>"), (7, "u", "same"), (7, "u", "same"), (8, "u", "same")]  # repeated ids and rows
    return rows


@pytest.mark.parametrize("least", [0, 17])
def test_pages_against_brute_force(spark, least):
    rows = hard_rows()
    got = sorted((tuple(r) for r in warc.archived_pages(pages_frame(spark, rows), least).collect()), key=str)
    assert got == expected(rows, least)


def test_no_pages(spark):
    assert warc.archived_pages(pages_frame(spark, [])).count() == 0


def test_archives_are_plain_gzip_members(spark):
    path = new_path(spark, "test")
    rows = [(i, "http://h", "text " * i) for i in range(40)]
    warc.write_warc(warc.with_responses(pages_frame(spark, rows, 2)), path)
    names = [f"{path}/{f}" for f in os.listdir(path) if f.endswith(".txt")]
    whole = b"".join(gzip.open(f).read() for f in names)
    assert whole.count(b"WARC/1.1\r\n") == 40 and whole.count(b"WARC-Type: response") == 40
    for f in names:
        data = open(f, "rb").read()
        while data:
            d = zlib.decompressobj(31)
            assert d.decompress(data).startswith(b"WARC/1.1")
            data = d.unused_data


def test_members_that_do_not_end_in_zero():
    assert warc._row(b"x")[-1:] != b"" and gzip.decompress(warc._row(b"x") + b"\0") == b"x"
    data = bytes(17 << 20)
    assert warc.member(data)[-1] and gzip.decompress(warc._row(data) + b"\0") == data


def archive(seed, size=40):
    """Members whose payloads hold magics, whole members and whole records in stored bytes."""
    r = random.Random(seed)
    inner = warc.member(warc.record(10**6, "http://inner", b"not a record of this archive", None))
    payloads = []
    for _ in range(size):
        parts = [r.randbytes(r.randrange(400))]
        for _ in range(r.randrange(4)):
            parts += [r.choice([warc.MAGIC, warc.MAGIC + b"\0" * 7, inner, inner[:60], warc.member(b"WARX/1.0 no"), b"\0", b""]), r.randbytes(r.randrange(300))]
        payloads.append(b"".join(parts))
    return payloads, b"".join(warc.member(warc.record(i, f"http://h/{i}", p, None), level=0) for i, p in enumerate(payloads))


@pytest.mark.parametrize("split", [331, 4096])
def test_splits_at_any_byte(spark, split):
    payloads, data = archive(split, 15)
    folder = tempfile.mkdtemp(prefix="spark-")
    for i in range(2):
        with open(f"{folder}/{i}.warc", "wb") as f:
            f.write(data)
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = warc.read_warc(spark, folder)
        rows = sorted((r["page_id"], bytes(r["payload"])) for r in got.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == sorted((i, p) for i, p in enumerate(payloads) for _ in range(2))


def test_damaged_archives_are_errors(spark):
    _, data = archive(3, 5)
    for bad in (data[:-5], b"x" + data, data[:200] + bytes([data[200] ^ 1]) + data[201:]):
        folder = tempfile.mkdtemp(prefix="spark-")
        with open(f"{folder}/a.warc", "wb") as f:
            f.write(bad)
        with pytest.raises(Exception, match="inside a member|does not begin|belong to no record"):
            warc.read_warc(spark, folder).count()
