"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of frames and, as its last frame, a seek
table in the published seekable format (a skippable frame with the sizes of all frames). An index maps each record
to its frame and the offset inside, so one record is read by decompressing one frame; it is a column of the table
and, in a second skippable frame, part of the archive itself. Equal payloads are stored once:
the page with the smallest id is a response, the others are revisits that refer to it.

Bundles are rows (bundle, content, index) of a table that Spark writes and commits, so a lost executor leaves no half
archive, and any store that Spark reads will do. ``export`` writes them as .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from pathlib import Path

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import checkpointed

#: Payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 0
#: Uncompressed bytes of a frame and of a bundle at which the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 25
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the seekable format.
_SKIPPABLE_MAGIC, _SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Another skippable frame, of ours, that holds the index of records.
_INDEX_MAGIC = 0x184D2A51
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLE = "bundle string, content binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"


def record_id(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else int(page_id)}>"


def page_of(record: str | None) -> str | None:
    body = record[len("<urn:x-page:") : -1] if record else "null"
    return None if body == "null" else body


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the full payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, offset: int = 0) -> tuple[dict, bytes, int]:
    """(headers, block, offset of the next record)."""
    end = data.index(b"\r\n\r\n", offset)
    lines = data[offset:end].decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start, size = end + 4, int(headers["Content-Length"])
    return headers, data[start : start + size], start + size + 4


class Bundle:
    """Collects records into frames and closes with the seek table."""

    def __init__(self, level: int = 3):
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.held, self.bytes = [], 0, 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, name: str, record: bytes) -> None:
        if self.held and self.held + len(record) > FRAME_BYTES:
            self._close_frame()
        self.index.append((name, len(self.frames), self.held, len(record)))
        self.open.append(record)
        self.held += len(record)
        self.bytes += len(record)

    def _close_frame(self) -> None:
        if self.held:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.open, self.held = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEK_MAGIC)
        index = "".join(f"{name}\t{frame}\t{offset}\t{length}\n" for name, frame, offset, length in self.index).encode()
        return b"".join(self.frames) + struct.pack("<II", _INDEX_MAGIC, len(index)) + index + struct.pack("<II", _SKIPPABLE_MAGIC, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != _SEEK_MAGIC:
        raise ValueError("no seek table")
    at, found = 0, []
    for packed, size in struct.iter_unpack("<II", content[-9 - 8 * n : -9]):
        found.append((at, packed, size))
        at += packed
    return found


def read_frame(content: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=size)


def read_index(content: bytes) -> dict[str, tuple[int, int, int]]:
    """Record identifier to (frame, offset, length), from the frame before the seek table; the last of repeated ones."""
    at = sum(packed for _, packed, _ in seek_table(content))
    magic, size = struct.unpack("<II", content[at : at + 8])
    if magic != _INDEX_MAGIC:
        raise ValueError("no index of records")
    lines = content[at + 8 : at + 8 + size].decode().splitlines()
    return {name: (int(frame), int(offset), int(length)) for name, frame, offset, length in (line.split("\t") for line in lines)}


def read_one(content: bytes, name: str) -> tuple[dict, bytes]:
    """One record of an archive by its identifier: a seek, one frame, an offset."""
    frame, offset, _ = read_index(content)[name]
    return parse_record(read_frame(content, seek_table(content)[frame]), offset)[:2]


def plan_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to: refers_to is null for a response.

    The smallest page_id of every repeated payload is found by an aggregation of digests (combined before the
    shuffle) and joined to the digests of the pages. A payload that holds more than 1/256 of all pages is a hot key;
    there are fewer than 256 of those, so their digests are broadcast and no page of theirs moves.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    same = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
    repeated = checkpointed(same.where("n > 1").select(F.col("sha").alias("s"), "first_page", "n"))
    hot = [bytes(row["s"]) for row in repeated.where(F.col("n") * 256 > F.lit(pages.count())).select("s").collect()]
    alike = (F.col("sha") == F.col("s")) & (F.octet_length("payload") >= least)
    is_hot = F.col("sha").isin(hot) & (F.octet_length("payload") >= least)
    joined = (rows.where(~is_hot) if hot else rows).join(repeated.where(~F.col("s").isin(hot)) if hot else repeated, alike, "left")
    if hot:
        joined = joined.unionByName(rows.where(is_hot).join(F.broadcast(repeated.where(F.col("s").isin(hot))), alike))
    later = F.col("first_page").isNotNull() & F.coalesce(F.col("page_id") > F.col("first_page"), F.lit(True))
    return joined.select("page_id", "url", "payload", F.when(later, F.col("first_page")).alias("refers_to"))


def write_bundles(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(bundle, content, index) rows of archives that hold one record for every row of ``pages`` (page_id, url, html).

    Null html is an empty payload, a null url an empty URI, a null page_id the identifier ``null``; a null page_id
    comes after all others. Rows that repeat a page_id are written each; those with the smallest page_id of a
    payload are all responses. Very long payloads get a frame of their own. No rows, no bundles.
    """

    def write(batches):
        part, n, bundle = TaskContext.get().partitionId(), 0, Bundle()
        row = lambda: pd.DataFrame({"bundle": [f"bundle-{part:06d}-{n:04d}"], "content": [bundle.finish()], "index": [bundle.index]})
        for pdf in batches:
            for page, url, payload, refers in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"]):
                bundle.add(record_id(page), build_record(page, url, bytes(payload), refers, refers is not None))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield row()
                    n, bundle = n + 1, Bundle()
        if bundle.index:
            yield row()

    # Ids travel as text: pandas would make nullable longs floats, which round beyond 2^53.
    typed = plan_revisits(pages, least).select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    return typed.mapInPandas(write, BUNDLE)


READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_bundles(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, frame by frame.

    A response whose payload does not have the digest of its header, or an index entry that does not lead to its
    record, is an error.
    """

    def read(batches):
        for pdf in batches:
            for content, index in zip(pdf["content"], pdf["index"]):
                content, rows = bytes(content), []
                frames, entries = seek_table(content), [tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in index]
                data, current = b"", -1
                for name, frame, offset, _ in entries:
                    if frame != current:
                        data, current = read_frame(content, frames[frame]), frame
                    headers, block, _ = parse_record(data, offset)
                    if headers["WARC-Record-ID"] != name:
                        raise ValueError(f"{name}: the index leads to {headers['WARC-Record-ID']}")
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and digest32(payload) != digest:
                        raise ValueError(f"{name}: payload and digest differ")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    rows.append((page_of(name), size, digest, kind, page_of(headers.get("WARC-Refers-To"))))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    found = bundles.mapInPandas(read, READ)
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def export(bundles: DataFrame, folder: str) -> list[str]:
    """Write every bundle as ``folder``/name.warc.zst, one at a time through the driver."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    for row in bundles.select("bundle", "content").toLocalIterator():
        (Path(folder) / f"{row['bundle']}.warc.zst").write_bytes(row["content"])
        names.append(f"{row['bundle']}.warc.zst")
    return sorted(names)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS first_page FROM p GROUP BY payload),
h AS (SELECT page_id, octet_length(p.payload)::BIGINT AS payload_bytes, sha1(p.payload) AS hex, CASE WHEN p.page_id > first_page THEN first_page END AS refers_to FROM p JOIN f USING (payload)),
b AS (SELECT *, list_transform(range(32), lambda i: (('0x' || substr(hex, (1 + (i * 5) // 4)::INT, 2))::INT >> (3 - (i * 5) % 4)::INT) & 31) AS groups FROM (SELECT * REPLACE (hex || '0' AS hex) FROM h))
SELECT page_id, payload_bytes, list_aggregate(list_transform(groups, lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (g + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM b
"""
