"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record.

The reader takes the dictionary from the skippable frame (raw, or itself a Zstandard frame), decodes one frame per record
and checks the record's version line, its headers, its length and its digest. The writer makes archives of that form.
Archives are rows (archive id, bytes), so that they can come from Spark's binaryFile source or from a table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.base import HOT, cut, join_spread

#: Magic numbers of the format: the skippable frame of the dictionary, a data frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Limits of a written archive, in records and payload bytes, and of the sample of a dictionary.
MAX_RECORDS, MAX_BYTES, SAMPLE, DICTIONARY, PIECE = 2_000, 16 << 20, 64, 1 << 14, 1 << 13


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_type: str, name: str, url: str | None, payload_digest: str, block: bytes, refers_to: str | None = None) -> bytes:
    """One record. A revisit has no block, but the digest of the payload that it refers to."""
    head = [f"WARC-Type: {record_type}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class ArchiveWriter:
    """Frames records of one archive with a dictionary; the archive begins with the dictionary's skippable frame."""

    def __init__(self, dictionary: bytes = b"", level: int = 3):
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True, write_content_size=True)
        self.parts = [SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary]

    def add(self, record: bytes) -> None:
        self.parts.append(self.zstd.compress(record))

    def bytes(self) -> bytes:
        return b"".join(self.parts)


def make_dictionary(samples: list[bytes]) -> bytes:
    """A raw-content dictionary: the beginnings of some payloads, bounded in size. Results don't depend on it, only sizes do."""
    return b"".join(s[: DICTIONARY // SAMPLE] for s in samples[:SAMPLE])


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    problems: list[str] = field(default_factory=list)


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive. What is wrong with one is told in its problems; a broken frame ends the archive."""
    dictionary, at = b"", 0
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == SKIPPABLE:
        at = 8 + int.from_bytes(data[4:8], "little")
        dictionary = data[8:at]
        if int.from_bytes(dictionary[:4], "little") == FRAME:
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    view = memoryview(data)
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        one, parts, end = zstd.decompressobj(), [], at
        try:
            while not one.eof and end < len(data):  # in small pieces: what follows the frame is handed back as a copy
                parts.append(one.decompress(view[end : end + PIECE]))
                end = min(end + PIECE, len(data))
        except zstandard.ZstdError as e:
            yield Record(problems=[f"frame at {at}: {e}"])
            return
        if not one.eof:
            yield Record(problems=[f"frame at {at} is cut off"])
            return
        at = end - len(one.unused_data)
        yield parse_record(b"".join(parts))


def parse_record(raw: bytes) -> Record:
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    r = Record()
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        r.problems.append("no version line")
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            r.problems.append("header without a colon")
        r.headers[name.strip().lower()] = value.strip()
    r.problems += [f"no {name}" for name in REQUIRED if name not in r.headers]
    told = r.headers.get("content-length", "")
    n = int(told) if told.isdigit() else -1
    r.block = rest[:n] if n >= 0 else rest
    if not found or rest[n:] != b"\r\n\r\n":
        r.problems.append(f"{len(rest) - 4} bytes of block, not {told}")
    stated = r.headers.get("warc-payload-digest", "").rpartition(":")[2]
    if stated and r.headers.get("warc-type") != "revisit" and stated != digest(r.block):
        r.problems.append("payload digest differs")
    return r


def plan_records(pages: DataFrame, min_bytes: int = 0, prefix: str = "urn:page:") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of the record to write per row.

    Of rows with equal payloads of at least min_bytes, the one with the smallest page_id is the response and the others
    revisit it; rows with smaller payloads are all responses. Equality is that of SHA-1 and length, found by sums per digest
    within the tasks first, so one payload may be most of the rows. Null html is empty; a page_id that comes again with the
    same payload gives a response each time. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    small = hashed.select("page_id", "sha", F.length("payload").cast("long").alias("n"))
    first = small.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    again = cut(first.where(F.col("rows") > 1))
    # Digests that come once are not in again; where it is small, Spark sends it to the pages and their payloads stay put.
    sized = hashed.withColumn("n", F.length("payload").cast("long"))
    return join_spread(sized, again.drop("rows"), ["sha", "n"], "page_id", "left", again.where(F.col("rows") > HOT)).select(
        "page_id",
        "url",
        "payload",
        F.col("n").alias("payload_bytes"),
        F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"),
    )


def write_archives(planned: DataFrame) -> DataFrame:
    """archive_id, archive (binary): the planned records, framed; one task writes archives of up to 2000 records or 16 MB.

    The names of the records are urn:page:<page_id>; the payloads' lengths and digests are in headers of their own too, so
    that a revisit without a block still tells them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, n, size, first = None, 0, 0, None
        for batch in batches:
            pages_, urls, payloads, refers_ = (batch.column(i).to_pylist() for i in range(4))
            for page, url, payload, refers in zip(pages_, urls, payloads, refers_):
                if writer is None:
                    writer, n, size, first = ArchiveWriter(make_dictionary(payloads)), 0, 0, page
                sha, revisit = digest(payload), refers is not None
                head = record_bytes("revisit" if revisit else "response", f"urn:page:{page}", url, sha, b"" if revisit else payload, f"urn:page:{refers}")
                writer.add(head.replace(b"\r\nContent-Type:", f"\r\nX-Payload-Length: {len(payload)}\r\nContent-Type:".encode(), 1))
                n, size = n + 1, size + len(payload)
                if n >= MAX_RECORDS or size >= MAX_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([str(first)]), pa.array([writer.bytes()], pa.binary())], names=["archive_id", "archive"])
                    writer = None
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([str(first)]), pa.array([writer.bytes()], pa.binary())], names=["archive_id", "archive"])

    return planned.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive_id string, archive binary")


def read_archives(archives: DataFrame, content: str = "archive", blocks: bool = True) -> DataFrame:
    """One row per record of each archive: headers map, block (null if blocks is False), block_bytes, block_digest, problems.

    archives: any DataFrame with a binary column, such as spark.read.format("binaryFile"). Null archives have no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string(), pa.list_(pa.string())]
        names = ["headers", "block", "block_bytes", "block_digest", "problems"]
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for r in read_archive(data.as_py() or b""):
                    rows.append((list(r.headers.items()), r.block if blocks else None, len(r.block), digest(r.block), r.problems))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return archives.select(content).mapInArrow(run, "headers map<string,string>, block binary, block_bytes bigint, block_digest string, problems array<string>")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The contract's columns, as read back: the pages are written to archives, which are kept in the checkpoint folder as
    a table of bytes, and every value comes from the records read from there."""
    written = cut(write_archives(plan_records(pages, min_bytes)))
    r = read_archives(written, blocks=False)
    header = lambda name: F.element_at("headers", name)
    page = lambda name: F.regexp_extract(header(name), r"^<urn:page:(-?[0-9]+)>$", 1)
    revisit = header("warc-type") == "revisit"
    out = r.select(
        page("warc-record-id").try_cast("long").alias("page_id"),
        F.when(revisit, header("x-payload-length").try_cast("long")).otherwise(F.col("block_bytes")).alias("payload_bytes"),
        F.when(revisit, F.replace(header("warc-payload-digest"), F.lit("sha1:"), F.lit(""))).otherwise(F.col("block_digest")).alias("payload_digest"),
        header("warc-type").alias("record_type"),
        F.when(revisit, page("warc-refers-to").try_cast("long")).alias("refers_to"),
        F.size("problems").alias("n_problems"),
    )
    return out
