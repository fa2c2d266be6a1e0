"""Operator 7: WARC archives as seekable Zstandard bundles with a map from records to frame-relative offsets."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: Bytes of records in a frame before it is closed, and in a bundle.
FRAME, BUNDLE = 256 << 10, 8 << 20
LEVEL = 3
# Fixed values of the seekable format and of WARC revisits.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

ARCHIVE = "bundle string, content binary, index array<struct<page_id:bigint,frame:int,offset:bigint,length:bigint>>"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str | None = None) -> bytes:
    """One WARC record: the payload in a response, or without it a revisit that names the page it repeats. A record that revisits refer
    to is named after its page, others after a name of their own."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name or f'page:{page_id}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    block = _HTTP + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame of each frame's compressed and plain size."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def frames_of(content: bytes) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, read from the footer alone."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    at, found = 0, []
    for size, _ in struct.iter_unpack("<II", content[-9 - 8 * n : -9]):
        found.append((at, size))
        at += size
    return found


def _write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, made, packer = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=LEVEL)
    out, sizes, index, open_frame, plain, seen = bytearray(), [], [], bytearray(), 0, set()

    def close_frame():
        nonlocal plain
        if open_frame:
            packed = packer.compress(bytes(open_frame))
            out.extend(packed)
            sizes.append((len(packed), len(open_frame)))
            plain += len(open_frame)
            open_frame.clear()

    def close_bundle():
        nonlocal made, plain
        close_frame()
        row = pd.DataFrame({"bundle": [f"{part:06d}-{made:06d}"], "content": [bytes(out) + seek_table(sizes)], "index": [list(index)]})
        made, plain = made + 1, 0
        out.clear(), sizes.clear(), index.clear()
        return row

    for f in frames:
        for page_id, url, html, first in zip(f["page_id"].astype("Int64"), f["url"], f["html"], f["first_id"].astype("Int64")):
            page_id = None if page_id is pd.NA else int(page_id)
            refers_to = None if first is pd.NA or first == page_id else int(first)
            named = first is not pd.NA and refers_to is None and page_id not in seen
            if named:  # pages of repeated payloads only
                seen.add(page_id)
            data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, None if named else f"record:{part}:{made}:{len(index)}:{page_id}")
            index.append({"page_id": page_id, "frame": len(sizes), "offset": len(open_frame), "length": len(data)})
            open_frame += data
            if len(open_frame) >= FRAME:
                close_frame()
                if plain >= BUNDLE:
                    yield close_bundle()
    if index:
        yield close_bundle()


def write_archive(pages: DataFrame) -> DataFrame:
    """A table of bundles (ARCHIVE) in the shared folder: one WARC record per row of pages.

    Of rows with equal payloads (null html: empty) the one with the smallest page_id is written as response, the others as
    revisits to it; rows that share that page_id too are responses each. Null page_ids yield to others and are responses where
    they have no other. A page goes over the network once, to meet its payload's smallest page_id where that isn't unique.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    many = stash(rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first_id"), "repeated-payloads")
    joined = rows.join(many, F.col("digest") == F.col("d"), "left").select("page_id", "url", "html", "first_id")
    return stash(joined.mapInPandas(_write, ARCHIVE), "warc")


def _facts(data: bytes) -> tuple:
    headers, payload = parse(data)
    revisit = headers["WARC-Type"] == "revisit"
    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
    if not revisit and (payload_digest(payload), len(payload)) != (digest, size):
        raise ValueError(f"record {headers['WARC-Record-ID']} doesn't hold its payload")
    page_id = headers.get("X-Page-ID")
    return page_id and int(page_id), size, digest, headers["WARC-Type"], int(headers["X-Refers-To-Page"]) if revisit else None


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpacker = zstandard.ZstdDecompressor()
    for f in frames:
        for content, index in zip(f["content"], f["index"]):
            starts, now, plain, rows = frames_of(content), -1, b"", []
            for x in sorted(index, key=lambda x: (x["frame"], x["offset"])):
                if x["frame"] != now:
                    now = x["frame"]
                    at, size = starts[now]
                    plain = unpacker.decompress(content[at : at + size])
                rows.append(_facts(plain[x["offset"] : x["offset"] + x["length"]]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archive(archive: DataFrame) -> DataFrame:
    """READ of every record, from the bundles' bytes; only frames that the index names are unpacked."""
    return archive.select("content", "index").mapInPandas(_read, READ)


def read_pages(archive: DataFrame, page_ids: DataFrame) -> DataFrame:
    """READ of the records of the given page_ids: bundles without one are skipped, and frames without one stay packed."""
    wanted = archive.select("bundle", F.explode("index").alias("x")).join(page_ids.select(F.col("page_id").alias("id")).distinct(), F.col("x.page_id") == F.col("id"), "left_semi")
    wanted = wanted.groupBy("bundle").agg(F.collect_list("x").alias("index"))
    return read_archive(archive.select("bundle", "content").join(wanted, "bundle"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(write_archive(table(spark, sf_dir, "pages")))


OP7_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, p, array_to_string(list_transform(range(40), lambda j: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(x, j + 1, 1))]), '') AS bits FROM h),
d AS (SELECT page_id, strlen(p) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest FROM b),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d JOIN f USING (payload_digest)
"""
