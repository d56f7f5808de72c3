"""Zstandard WARC archives: a writer, and a reader that takes the dictionary from the leading skippable frame.

An archive is a skippable frame with the (compressed) dictionary, a warcinfo record, then one frame a record. The
reader finds each frame's end from its block headers, decodes it alone, and validates the record: version line,
required headers, Content-Length against the block, the trailing blank lines, and block and payload digests.

``archive_pages`` writes pages: of equal payloads the one with the largest page_id is a response, the others are
revisits that carry the payload's digest and length but not the payload. Archives are rows of a binary table in the
shared folder, so any store that Spark reaches holds them; ``write_files`` and ``read_files`` handle real files.

Defined results: NULL html is the empty payload and NULL url the empty target, whose line ends are percent-encoded; rows
with equal page_id are records of their own (of equal payloads and page_ids all are responses); a row without page_id
is a record without one, which revisits the largest page_id that has its payload and else is a response; an empty table gives an empty result; other columns are
ignored. A damaged archive raises WarcError that names the record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.sampling import hash_sample
from gleaner.operators.skew import join_counted
from gleaner.workspace import Workspace

#: Fixed values of the formats.
SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2000-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


_NO_ID = 1 << 16


def record_urn(page_id: int | None) -> str:
    """A version 8 UUID that holds the 64 bits of the id, or a mark that there is none."""
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=(8 << 76) | (2 << 62) | _NO_ID)}>"
    n = page_id & (2**64 - 1)
    return f"<urn:uuid:{uuid.UUID(int=(n >> 16 << 80) | (8 << 76) | (2 << 62) | (n & 0xFFFF))}>"


def page_of_urn(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if n & _NO_ID:
        return None
    n = (n >> 80) << 16 | n & 0xFFFF
    return n - 2**64 if n >> 63 else n


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = url.replace("\r", "%0D").replace("\n", "%0A").encode()
    head = [
        VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + record_urn(page_id).encode(),
        b"WARC-Date: " + DATE, b"WARC-Target-URI: " + target, b"WARC-Payload-Digest: sha1:" + digest(payload).encode(),
        b"WARC-Block-Digest: sha1:" + digest(block).encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + record_urn(refers_to).encode(), b"WARC-Profile: " + REVISIT_PROFILE]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    def __init__(self, dictionary: bytes, level: int = 3):
        self.out: list[bytes] = []
        data = None
        if dictionary:
            packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
            self.out.append(struct.pack("<II", SKIP_MAGIC, len(packed)) + packed)
            data = zstandard.ZstdCompressionDict(dictionary)
        self._zip = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True, write_content_size=True)
        info = b"software: gleaner\r\nformat: WARC File Format 1.1\r\n"
        self.add(b"\r\n".join([VERSION, b"WARC-Type: warcinfo", b"WARC-Record-ID: " + f"<urn:uuid:{uuid.UUID(int=0)}>".encode(), b"WARC-Date: " + DATE, b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(info)]) + b"\r\n\r\n" + info + b"\r\n\r\n")

    def add(self, record: bytes) -> int:
        self.out.append(self._zip.compress(record))
        return len(self.out[-1])

    def close(self) -> bytes:
        return b"".join(self.out)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its header and block headers."""
    try:
        head = bytes(data[at : at + 18])
        p = zstandard.get_frame_parameters(head)
        at += zstandard.frame_header_size(head)
        last = False
        while not last:
            b = int.from_bytes(data[at : at + 3], "little")
            last, kind, size = b & 1, b >> 1 & 3, b >> 3
            if at + 3 > len(data) or kind == 3:
                raise WarcError("a frame is cut or damaged")
            at += 3 + (1 if kind == 1 else size)
    except zstandard.ZstdError as e:
        raise WarcError(str(e)) from e
    at += 4 * p.has_checksum
    if at > len(data):
        raise WarcError("a frame is cut")
    return at


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC version line or no end of headers")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise WarcError(f"not a header: {line[:40]!r}")
        name = k.decode().lower()
        fields[name] = (v.removeprefix(b" ") if name == "warc-target-uri" else v.strip()).decode()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise WarcError(f"{need} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"{fields['warc-record-id']}: Content-Length doesn't match the record")
    block = rest[:-4]
    if (d := fields.get("warc-block-digest")) and d.removeprefix("sha1:") != digest(block):
        raise WarcError(f"{fields['warc-record-id']}: the block's digest is wrong")
    return fields, block


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, the warcinfo record included."""
    view, at, words = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIP_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("the dictionary frame is cut")
        packed = bytes(view[8 : 8 + size])
        if packed[:4] == struct.pack("<I", FRAME_MAGIC):
            packed = zstandard.ZstdDecompressor().decompress(packed)
        words, at = zstandard.ZstdCompressionDict(packed), 8 + size
    unzip = zstandard.ZstdDecompressor(dict_data=words)
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        end = frame_end(view, at)
        try:
            raw = unzip.decompressobj().decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        yield parse_record(raw)
        at = end


def http_payload(fields: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """The full payload's length, and the payload of a response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    if fields["warc-type"] == "response":
        if size != len(payload):
            raise WarcError(f"{fields['warc-record-id']}: the payload's length is wrong")
        if fields.get("warc-payload-digest", "").removeprefix("sha1:") != digest(payload):
            raise WarcError(f"{fields['warc-record-id']}: the payload's digest is wrong")
        return size, payload
    return size, None


def train_dictionary(pages: DataFrame, column: str = "html", sample: int = 200, size: int = 16 << 10) -> bytes:
    """A dictionary from at most ``sample`` whole texts of pages chosen by hash; empty where they are too few to train on."""
    ids = hash_sample(pages.select("page_id").filter("page_id is not null"), ["page_id"], sample).distinct()
    rows = pages.join(F.broadcast(ids), "page_id").filter(F.length(column) > 0).select(column).limit(sample).collect()
    try:
        return zstandard.train_dictionary(size, [r[0].encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0, archive_bytes: int = 4 << 20, work: Workspace | None = None) -> DataFrame:
    """The written archives: (archive, content). Archives close at ``archive_bytes`` or the end of a task."""
    spark = pages.sparkSession
    work = work or Workspace(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    words = train_dictionary(rows)
    mark = F.when(F.octet_length("html") >= min_revisit_bytes, F.unhex(F.sha1("html")))
    rows = rows.withColumn("mark", mark)
    equal = work.stash(rows.filter("mark is not null").groupBy("mark").agg(F.count("*").alias("copies"), F.max("page_id").alias("keeper")).filter("copies > 1"), "equal")
    judged = join_counted(rows, equal, ["mark"], "copies", F.struct("page_id", "url"), "left")

    def of(batches):
        from pyspark import TaskContext

        task, serial, writer, size = TaskContext.get().partitionId(), 0, None, 0

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{serial:06d}.warc.zst"], pa.string()), pa.array([writer.close()], pa.binary())], ["archive", "content"])

        for b in batches:
            for page_id, url, html, keeper in zip(*(b.column(c) for c in ("page_id", "url", "html", "keeper")), strict=True):
                if writer is None:
                    writer, size = ArchiveWriter(words), 0
                page, keep = page_id.as_py(), keeper.as_py()
                size += writer.add(build_record(page, url.as_py(), html.as_py().encode(), keep if keep is not None and page != keep else None))
                if size >= archive_bytes:
                    yield closed()
                    writer, serial = None, serial + 1
        if writer is not None:
            yield closed()

    return work.stash(judged.mapInArrow(of, "archive string, content binary"), "archives")


def read_pages(archives: DataFrame) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (NULL in revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def of(batches):
        for b in batches:
            for content in b.column("content"):
                out = []
                for fields, block in read_archive(content.as_py()):
                    if fields["warc-type"] in ("response", "revisit"):
                        size, payload = http_payload(fields, block)
                        refers = fields.get("warc-refers-to")
                        out.append((page_of_urn(fields["warc-record-id"]), size, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], page_of_urn(refers) if refers else None, fields.get("warc-target-uri"), payload))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return archives.select("content").mapInArrow(of, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def read_files(spark, path: str) -> DataFrame:
    return read_pages(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path))


def write_files(archives: DataFrame, folder: str) -> int:
    """Files in a folder of the driver, one archive at a time; for exports, not for jobs."""
    n = 0
    for row in archives.toLocalIterator():
        with open(f"{folder}/{row.archive}", "wb") as f:
            f.write(row.content)
        n += 1
    return n
