"""WARC archives of one gzip member a record: a writer, and a reader that splits anywhere.

Reading. Spark's text source with the gzip magic as its line separator hands
every task a byte range of a file, cut at the magics that start inside it. Some
of these are chance bytes of compressed data, so each candidate is tried: its
gzip header must decode and the text must begin with a WARC version. A member is
then inflated to its end, over false candidates where they lie inside it, and
its checksum is tested by zlib. A range owns the members that start in it; what
one of them lacks at the range's end is taken from the next ranges in rounds.

Writing. The text sink puts a separator behind every row. A member ends with
its length, whose last byte is zero below 16 MB, so rows are members without
their last byte and the separator is that zero: files are plain sequences of
members. A longer record is followed by an empty member, which ends in zero.
Spark's source reads files called ``.gz`` as one stream and inflates them, so
archives to be read here need another name.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import written
from loomline.operators.joins import lookup_join
from loomline.session import new_path

MAGIC = b"\x1f\x8b\x08"
VERSION, START = b"WARC/1.1", b"WARC/"
EPOCH = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = "file string, start long, first int, last int, bytes binary"
RECORDS = "record_id string, type string, uri string, date string, payload_digest string, refers_to string, page_id long, http string, payload_length long, payload binary"


# ---- writing ---------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str = EPOCH) -> bytes:
    """One uncompressed record; a revisit has the response's HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = " ".join((uri or "").split())
    head = [
        VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, wbits=31)
    return c.compress(data) + c.flush()


def _row(data: bytes) -> bytes:
    """Members that end in zero, without that zero."""
    m = member(data)
    if m[-1]:
        m += member(b"")
    return m[:-1]


def _written_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            cols = [part[n].to_pylist() for n in ("page_id", "uri", "payload", "refers_to")]
            rows = [_row(record(p, u, x or b"", r)) for p, u, x, r in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])


def write_warc(rows: DataFrame, path: str) -> None:
    """Archives of ``(page_id, uri, payload binary, refers_to)`` in the folder ``path``, one file a task.

    A row with ``refers_to`` becomes a revisit of that page's record, others a
    response. A null payload or uri is empty; white space in a uri becomes one
    space, as a header line cannot hold line breaks.
    """
    packed = rows.select("page_id", "uri", "payload", "refers_to").mapInArrow(_written_rows, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


# ---- reading -----------------------------------------------------------------


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, at, value)``: what stands between gzip magics, by byte range; ``at`` orders the rows of a range."""
    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))


class _Member:
    """A member that is fed piece by piece."""

    def __init__(self, first: int):
        self.first, self.inflater, self.out, self.packed = first, zlib.decompressobj(31), [], []

    def feed(self, piece: bytes) -> bool:
        """True once the member is complete; zlib.error if it is none, or holds something other than a record."""
        self.packed.append(piece)
        self.out.append(self.inflater.decompress(piece))
        begin = b"".join(self.out) if len(self.out) < 3 else self.out[0]
        if not (begin.startswith(START) or START.startswith(begin)) or self.inflater.eof and 0 < len(begin) < len(START):
            raise zlib.error("no WARC record")
        if self.inflater.eof and self.inflater.unused_data.strip(b"\0"):
            raise zlib.error("bytes behind a member")
        if len(self.out) > 1 and len(self.out[0]) < len(START):
            self.out = [b"".join(self.out)]
        return self.inflater.eof

    def bytes(self) -> bytes:
        return b"".join(self.out)


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that start in each range: ``bytes`` inflated, last >= first; open ones still packed, last = -1;
    candidates that are no start and belong to no member of this range, last = -2."""
    key, index, open_ = None, 0, None

    def out(first: int, last: int, data: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([first], pa.int32()), pa.array([last], pa.int32()), pa.array([data], pa.binary())],
            ["file", "start", "first", "last", "bytes"])

    for b in batches:
        for file, start, value in zip(b["file"].to_pylist(), b["start"].to_pylist(), b["value"].to_pylist(), strict=True):
            if (file, start) != key:
                if open_:
                    yield out(open_.first, -1, b"".join(open_.packed))
                key, index, open_ = (file, start), 0, None
                if start == 0:  # what stands before the first magic
                    if value:
                        raise ValueError(f"{file} does not begin with a gzip member")
                    index = 1
                    continue
            todo = deque([MAGIC + value])
            while todo:
                open_ = open_ or _Member(index)
                try:
                    done = open_.feed(todo.popleft())
                except zlib.error:  # its first candidate is none, those behind it are tried again
                    yield out(open_.first, -2, None)
                    todo.extendleft(reversed(open_.packed[1:]))
                    index, open_ = open_.first + 1, None
                    continue
                if done:
                    data = open_.bytes()
                    if data:
                        yield out(open_.first, index, data)
                    open_ = None
                index += 1
    if open_:
        yield out(open_.first, -1, b"".join(open_.packed))


def _continued(key, opened: pa.Table, pieces: pa.Table) -> pa.Table:
    """Open members with the candidates of the range behind them."""
    out = {"file": [], "start": [], "first": [], "last": [], "bytes": [], "end_start": []}
    values = pieces.sort_by("at")["value"]
    for o in opened.to_pylist():
        m, last = _Member(o["first"]), -1
        try:
            m.feed(o["bytes"])
            for i, value in enumerate(values):
                if m.feed(MAGIC + value.as_py()):
                    last = i
                    break
        except zlib.error:
            last = -2
        data = m.bytes() if last >= 0 else b"".join(m.packed) if last == -1 else None
        for name, x in (("file", o["file"]), ("start", o["start"]), ("first", o["first"]), ("last", last), ("bytes", data), ("end_start", o["next"])):
            out[name].append(x)
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    return pa.table({n: pa.array(x, t) for (n, x), t in zip(out.items(), types, strict=True)})


def _members(spark: SparkSession, path: str) -> DataFrame:
    """Inflated records of all archives under ``path`` as ``bytes``."""
    scan = _scan(spark, path)
    found = written(scan.select("file", "start", "value").mapInArrow(_owned, _RECORD), "warc-members")
    whole, open_, loose = (found.where(x) for x in ("last >= 0", "last = -1", "last = -2"))
    if open_.isEmpty() and loose.isEmpty():
        return whole.select("bytes")
    # Few ranges get here: those whose last member has a chance magic beyond the range's end.
    starts = scan.select("file", "start").distinct()
    ranges = written(starts.select("file", F.col("start").alias("reached"), F.lead("start").over(Window.partitionBy("file").orderBy("start")).alias("next")), "warc-ranges")
    rest, spans = open_.withColumn("reached", F.col("start")), found.limit(0).withColumn("end_start", F.lit(0).cast("long"))
    while not rest.isEmpty():
        step = written(rest.drop("last").join(ranges, ["file", "reached"]).drop("reached"), "warc-open")
        if not step.where("next IS NULL").isEmpty():
            raise ValueError("an archive ends inside a member")
        wanted = scan.join(step.select("file", F.col("next").alias("start")).distinct(), ["file", "start"], "left_semi").withColumnRenamed("start", "next")
        got = step.groupBy("file", "next").cogroup(wanted.groupBy("file", "next")).applyInArrow(_continued, f"{_RECORD}, end_start long")
        got = written(got, "warc-continued")
        spans = spans.unionByName(got.where("last >= 0"))
        loose = loose.unionByName(got.where("last = -2").drop("end_start"))
        rest = got.where("last = -1").withColumnRenamed("end_start", "reached")
    # What lies inside a continued member, by range and candidate, was no record.
    inner = spans.select(F.col("file").alias("f"), F.col("start").alias("s"), F.col("first").alias("i"), F.col("end_start").alias("e"), F.col("last").alias("j"))

    def outside(frame: DataFrame) -> DataFrame:
        here, begin, end = F.struct("start", "first"), F.struct(F.col("s").alias("start"), F.col("i").alias("first")), F.struct(F.col("e").alias("start"), F.col("j").alias("first"))
        return frame.join(inner, (F.col("file") == F.col("f")) & (begin < here) & (here <= end), "left_anti")

    if not outside(loose).isEmpty():
        raise ValueError("bytes that belong to no record")
    return outside(whole).select("bytes").unionByName(outside(spans).select("bytes"))


def parsed(data: bytes) -> tuple:
    """The fields of RECORDS of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(h.get("content-length", 0))]
    http, length, payload = None, None, block
    if "application/http" in h.get("content-type", ""):
        http_head, _, payload = block.partition(b"\r\n\r\n")
        http = http_head.decode("latin-1")
        for x in http.split("\r\n")[1:]:
            k, _, v = x.partition(":")
            if k.strip().lower() == "content-length" and v.strip().isdigit():
                length = int(v)
    return (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"),
            h.get("warc-refers-to"), page_of(h.get("warc-record-id")), http, length, payload)


def page_of(name: str | None) -> int | None:
    """The page of a record that this module has named; null for others."""
    if name and name.startswith("<urn:page:") and name.endswith(">") and name[10:-1].removeprefix("-").isdigit():
        return int(name[10:-1])
    return None


_TYPES = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def _parsed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 64):
            cols = list(zip(*(parsed(x) for x in b["bytes"].slice(i, 64).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, one gzip member each, as RECORDS.

    ``payload`` is the block of a record, without its HTTP header where it has
    one. Empty files and empty members hold no record. A damaged member, an
    archive that ends inside one, and bytes of no record are errors.
    """
    return _members(spark, path).mapInArrow(_parsed_rows, RECORDS)


# ---- pages ---------------------------------------------------------------------


def with_responses(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(page_id, uri, payload, refers_to)``: of equal payloads of ``least`` bytes or more, records with the smallest
    page_id are responses and the others refer to it."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), payload.alias("payload"))
    keyed = base.withColumn("key", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    names = written(keyed.select("page_id", "key"), "warc-keys")
    groups = names.where("key IS NOT NULL").groupBy("key").agg(F.min("page_id").alias("smallest"), F.count("*").alias("n")).where("n > 1 AND smallest IS NOT NULL").drop("n")
    # Only pages whose payload occurs again are joined; a page is found by id and payload.
    again = lookup_join(names, groups, "key", "inner").where("NOT (page_id <=> smallest)")
    again = written(again.select(F.coalesce("page_id", F.lit(-(2**63)).cast("long")).alias("id"), "key", F.col("smallest").alias("refers_to")).distinct(), "warc-revisits")
    found = keyed.withColumn("id", F.coalesce("page_id", F.lit(-(2**63)).cast("long"))).join(again, ["id", "key"], "left")
    return found.select("page_id", "uri", "payload", "refers_to")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        out = []
        for name, kind, digest, refers, page, length, payload in zip(
                *(b[n].to_pylist() for n in ("record_id", "type", "payload_digest", "refers_to", "page_id", "payload_length", "payload")), strict=True):
            digest = digest.removeprefix("sha1:")
            if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                raise ValueError(f"{name}: payload does not match its header")
            out.append((page, length, digest, kind, page_of(refers)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def archived_pages(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of each page, read back from archives of all pages.

    Payloads of responses are tested against their digest; of revisits length
    and digest come from their headers. A null html is an empty payload, and
    empty payloads are equal like others. Rows repeated with the smallest id of
    their payload are all responses, as a record cannot revisit itself. Rows
    without page_id revisit the smallest id there is, and are responses if there
    is none. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(with_responses(pages, least), path)
    return read_warc(spark, path).mapInArrow(_digests, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
