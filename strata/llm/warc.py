"""WARC archives in Zstandard: one frame per record, behind a skippable frame that holds the dictionary.

Archives are written by Spark's own committed writer, some megabytes in a file. Records with equal payloads of some size are stored
once, as a response, and the others as revisits of it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, read_blobs, salted_left, write_blobs

DICTIONARY_FRAME, TRAILER_FRAME = 0x184D2A5D, "P*M\x18\0\0\0\0"  # the trailer is an empty skippable frame
SAMPLE_ROWS, SAMPLE_CHARS = 200, 4096  # what the dictionary is trained on
ARCHIVE_BYTES = 16_000_000  # of records, before compression
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or none if the samples are too few."""
    try:
        return zstandard.train_dictionary(32_768, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    def urn(i):
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"

    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": urn(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": urn(refers_to) if revisit else None,
        "WARC-Profile": PROFILE if revisit else None,
        "X-Page-ID": None if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
        "X-Refers-To-Page": str(refers_to) if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its headers alone."""
    if len(data) - at < 6:
        raise ValueError("a frame is cut off")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def archive(records: list[bytes], dictionary: bytes) -> bytes:
    """The file without its trailer."""
    packed = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary + b"".join(packed.compress(r) for r in records)


def frames(data: bytes):
    """The records of an archive. The dictionary comes from the leading skippable frame; other skippable frames are passed over."""
    view, at, unpack = memoryview(data), 0, None
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if len(view) - at >= 8 else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at == 0 and magic == DICTIONARY_FRAME and size:
                raw = bytes(view[8 : 8 + size])
                raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            if at > len(view):
                raise ValueError("a skippable frame is cut off")
            continue
        if magic != 0xFD2FB528:
            raise ValueError("not a Zstandard frame")
        unpack = unpack or zstandard.ZstdDecompressor()
        end = frame_end(view, at)
        # content sizes are in the frames that this module writes; others are read as streams
        yield unpack.decompress(view[at:end]) if zstandard.get_frame_parameters(view[at:end]).content_size not in (0, (1 << 64) - 1) else unpack.decompressobj().decompress(view[at:end])
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and payload of one record; ValueError where version, headers, lengths or digest don't hold."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#-'*+.0-9A-Z^-z|~-]+", name):
            raise ValueError("a header is malformed")
        headers[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ValueError(f"headers are missing: {sorted(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the length of the block does not agree")
    block = rest[:-4]
    if headers["warc-type"] != "response":
        return headers, block
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ValueError("not an HTTP response")
    if (said := headers.get("x-payload-length")) and int(said) != len(payload):
        raise ValueError("the length of the payload does not agree")
    if (said := headers.get("warc-payload-digest", "")).startswith("sha256:") and said[7:] != hashlib.sha256(payload).hexdigest():
        raise ValueError("the digest of the payload does not agree")
    return headers, payload


def write_archives(pages: DataFrame, least_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes a record per page; gives the folder."""
    sample = pages.where("html is not null").select(F.substring("html", 1, SAMPLE_CHARS).alias("html")).limit(SAMPLE_ROWS).collect()
    dictionary = train_dictionary([r.html.encode() for r in sample])
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    first = keyed.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    rows = salted_left(keyed, cut(first), "digest", "page_id")

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first"))):
                held.append(record(page_id, url, payload, digest, first, first is not None and page_id != first))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held, dictionary)], pa.binary())], ["data"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held, dictionary)], pa.binary())], ["data"])

    rows = rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "first")
    return write_blobs(rows.mapInArrow(pack, "data binary"), "data", TRAILER_FRAME)


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """A folder of archives -> page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload (empty for revisits) if asked for."""

    def rows(batches):
        from urllib.parse import unquote

        names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payloads
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        for batch in batches:
            for data in batch.column("content"):
                out = []
                for raw in frames(data.as_py()):
                    h, payload = parse(raw)
                    number = lambda k: int(h[k]) if k in h else None
                    url = unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None
                    out.append((number("x-page-id"), url, number("x-payload-length"), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"], number("x-refers-to-page")) + (payload,) * payloads)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return read_blobs(spark, path).select("content").mapInArrow(rows, RECORDS + ", payload binary" * payloads)


def archive_pages(pages: DataFrame, least_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages -> archives -> one row per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, all from the archives.

    Null html is an empty payload. Of equal payloads of ``least_bytes`` or more, the smallest page_id is the response (rows that
    repeat it too, and all rows if no id is known), and the others, those without an id included, are revisits. Empty tables give
    no rows, and further columns are ignored.
    """
    return read_archives(pages.sparkSession, write_archives(pages, least_bytes, archive_bytes))
