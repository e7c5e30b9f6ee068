"""WARC archives: a writer of response and revisit records, and a reader that salvages damaged files.

Records go through Spark's own text writer with the record separator as line separator, so archives are
committed like any Spark output and a lost executor's part is written again. Each record carries SHA-1
digests of its block and payload. The reader checks version line, headers, length, separator and digests;
after a failed check it searches for the next place where a valid record or gzip member begins, goes on
from there, and logs the bytes passed over as a quarantined gap.

A null payload is an empty one. A null id is written as an empty target and read back as null. Repeated
rows are records each: of equal payloads the largest id is the response, and rows that share that id too
are all responses. Long payloads go into archives of fewer records, since Spark reads an archive whole; headers may
have any length; a payload and its headers must stay below 2 GB, the most that a Spark value holds. An empty table
gives archives without records and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import common

END = b"\r\n\r\n"
VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
#: Payloads up to so many bytes go into archives of so many records: no archive holds more than 64 MB, or one record.
CLASSES = ((65_536, 1_000), (4_194_304, 16), (2**63 - 1, 1))


def b32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, http: bytes, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record without its final separator. A revisit's block ends after the HTTP headers."""
    block = http + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response")]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", b32(block))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def member(data: bytes) -> bytes:
    """A record with its separator as a gzip member of its own."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data + END) + pack.flush()


@dataclass
class Record:
    at: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    at: int
    size: int
    why: str


class Bad(Exception):
    pass


class Finder:
    """Where a mark comes next in data, for places that only grow: the data are passed over once a mark."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def __call__(self, mark: bytes, at: int) -> int:
        """Where it begins, or the length of the data."""
        if self.known.get(mark, -1) < at:
            found = self.data.find(mark, at)
            self.known[mark] = len(self.data) if found < 0 else found
        return self.known[mark]


def parse(data: bytes, at: int, find: Finder) -> tuple[Record, int]:
    """The record at `at` and where the next begins; Bad names the check that failed. Headers may have any length."""
    if not data.startswith(VERSION, at):
        raise Bad("no version line")
    headers, line = {}, at + len(VERSION)
    end = find(END, at)
    if end == len(data):
        raise Bad("headers do not end")
    while line < end + 2:
        after = data.find(b"\r\n", line, end + 2)
        key, colon, value = data[line:after].decode(errors="replace").partition(":")
        if not colon or not key.strip():
            raise Bad("header without a colon")
        headers[key.strip().lower()], line = value.strip(), after + 2
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        raise Bad("no length or type")
    begin, size = end + len(END), int(headers["content-length"])
    if not data.startswith(END, begin + size):
        raise Bad("no separator where the record should end")
    block = data[begin : begin + size]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != b32(block):
        raise Bad("block digest differs")
    return Record(at, headers, block), begin + size + len(END)


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The member at `at` and where the next begins, read in steps: no more than the member is copied."""
    view, unpack, out = memoryview(data), zlib.decompressobj(31), []
    while at < len(data) and not unpack.eof:
        step = view[at : at + 65_536]
        try:
            out.append(unpack.decompress(step))
        except zlib.error as e:
            raise Bad(f"member: {e}") from None
        at += len(step)
    if not unpack.eof:
        raise Bad("member does not end")
    return b"".join(out), at - len(unpack.unused_data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that pass their checks, in order, and the gaps between them."""
    at, lost, why, find = 0, None, "", Finder(data)
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                inner, after = inflate(data, at)
                found, end = parse(inner, 0, Finder(inner))
                if end != len(inner):
                    raise Bad("more than a record in a member")
                found.at = at
            else:
                found, after = parse(data, at, find)
        except Bad as e:
            if lost is None:
                lost, why = at, str(e)
            at = min(find(VERSION, at + 1), find(GZIP, at + 1))
            continue
        if lost is not None:
            yield Gap(lost, at - lost, why)
            lost = None
        yield found
        at = after
    if lost is not None:
        yield Gap(lost, len(data) - lost, why)


def roles(pages: DataFrame, least: int, tables: common.Tables) -> DataFrame:
    """page_id, url, html and refers_to: the page whose response stands for this one's payload.

    Only digests and ids are shuffled to find repeated payloads, a partial maximum first. Those that repeat
    are written, and looked up by their checked size: a payload that very many pages share stays dealt."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = base.where(F.octet_length("payload") >= least)
    again = large.groupBy(F.col("digest").alias("twin")).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = common.look_up(base, tables(again, "payloads"), "digest", "twin", ["page_id"], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("refers_to")).alias("refers_to"))


def records(pages: DataFrame, rows: int) -> DataFrame:
    def work(ids: list, urls: list, payloads: list, digests: list, to: list) -> list:
        return [[record("response" if t is None else "revisit", i, u, http_head(len(p)), p, d, t) for i, u, p, d, t in zip(ids, urls, payloads, digests, to, strict=True)]]

    return common.map_columns(pages.select("page_id", "url", "payload", "digest", "refers_to"), "record binary", lambda: work, rows=rows)


def write(pages: DataFrame, path: str, least: int = 1000, classes: tuple = CLASSES) -> None:
    """Write archives below path, in a folder a class of payload sizes."""
    tables = common.Tables()
    rows, size = roles(pages, least, tables), F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    most = pages.agg(F.max(size)).first()[0] or 0
    low = -1
    for k, (high, per_file) in enumerate(classes):
        if low < most or not k:
            own = rows.where((F.octet_length("payload") > low) & (F.octet_length("payload") <= high)) if most > classes[0][0] else rows
            lines = records(own, max(1, min(500, per_file))).select(F.col("record").cast("string").alias("value"))
            lines.write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).text(f"{path}/size{k}")
        low = high
    tables.drop_but()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps: archive, at, kind ('gap' for one), page_id, payload_bytes, payload_digest,
    refers_to, size (of a gap) and note. A payload whose digest differs from its header's is a gap."""

    def number(name: str) -> int | None:
        text = name.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def row(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return path, x.at, "gap", None, None, None, None, x.size, x.why
        head, _, payload = x.block.partition(END)
        kind, size, digest = x.headers["warc-type"], len(payload), x.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "revisit":
            size = next((int(v) for k, _, v in (h.partition(b":") for h in head.split(b"\r\n")) if k.lower() == b"content-length"), None)
        elif hashlib.sha1(payload).hexdigest() != digest:
            return path, x.at, "gap", None, None, None, None, len(x.block), "payload digest differs"
        refers = x.headers.get("warc-refers-to")
        return path, x.at, kind, number(x.headers.get("warc-record-id", "")), size, digest, number(refers) if refers else None, None, None

    def work(paths: list, contents: list) -> list:
        rows = [row(path, x) for path, data in zip(paths, contents, strict=True) for x in salvage(data)]
        return [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(9)]

    schema = "archive string, at long, kind string, page_id long, payload_bytes long, payload_digest string, refers_to long, size long, note string"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return common.map_columns(files.select("path", "content"), schema, lambda: work, rows=1)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    # These archives were just written, so a gap is a fault of the writer or the disk and not to be passed over.
    fault = F.raise_error(F.concat(F.lit("gap in "), "archive", F.lit(" at "), F.col("at").cast("string"), F.lit(": "), "note"))
    got = read(spark, path).where(F.when(F.col("kind") != "gap", F.lit(True)).otherwise(fault.cast("boolean")))
    got = common.scratch(got.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to"), "records")
    common.drop_scratch(spark, path)
    return got


ORACLE = """
    WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN payload_bytes < 1000 OR page_id = top THEN NULL ELSE top END AS refers_to FROM m"""
