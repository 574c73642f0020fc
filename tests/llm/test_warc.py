import hashlib

import pytest
import zstandard

from strata.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


def test_archives_hold_the_pages(spark):
    big, small = "<p>é" * 60, "<p>"
    rows = [(5, "http://a/é b", big, "x", 1), (2, None, big, "x", 1), (9, "u", small, "x", 1), (3, "u", small, "x", 1), (None, "u", big, "x", 1), (2, None, big, "x", 1), (7, "u", None, "x", 1), (8, "u", "", "x", 1), (11, "u", "long " * 50_000, "x", 1)]
    rows += [(100 + i, f"http://b/{i}", f"<html><body>page number {i}</body></html>" * 5, "x", 1) for i in range(200)]
    out = warc.archive_pages(spark.createDataFrame(rows, SCHEMA), archive_bytes=9000).collect()
    assert len(out) == len(rows)
    by = sorted((-1 if r.page_id is None else r.page_id, r.url or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    assert by == sorted(
        (-1 if i is None else i, u or "", len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and i != 2 else "response", 2 if h == big and i != 2 else None) for i, u, h, *_ in rows
    )


def test_payloads_are_read_back(spark):
    rows = [(i, "u", f"text {i} " * 30, "", 0) for i in range(5)]
    path = warc.write_archives(spark.createDataFrame(rows, SCHEMA))
    found = warc.read_archives(spark, path, payloads=True).collect()
    assert sorted(bytes(r.payload).decode() for r in found) == sorted(r[2] for r in rows)
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def records():
    return [warc.record(i, f"http://h/{i}", b"payload %d " % i * 40, hashlib.sha256(b"payload %d " % i * 40).hexdigest(), None, False) for i in range(50)]


def test_one_frame_per_record_behind_the_dictionary():
    dictionary = warc.train_dictionary([b"some sample %d of text that repeats" % i * 9 for i in range(300)])
    raw = warc.archive(records(), dictionary) + warc.TRAILER_FRAME.encode()
    assert dictionary and raw[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.frames(raw)) == records()
    # a dictionary that is compressed itself, and no dictionary at all
    packed = zstandard.ZstdCompressor().compress(dictionary)
    body = raw[8 + len(dictionary) :]
    assert list(warc.frames((0x184D2A5D).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + body)) == records()
    assert list(warc.frames(warc.archive(records(), b""))) == records()


def test_damage_is_found():
    raw = warc.archive(records(), b"")
    for bad in (raw[:-5], raw[:30] + b"xx" + raw[32:], b"xxxxxxxxxx"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(bad))
    whole = records()[0]
    for bad in (whole[:-1], whole + b"x", whole.replace(b"WARC/1.1", b"WARC/9"), whole.replace(b"WARC-Type: response\r\n", b""), whole.replace(b"payload 0", b"payload 1", 1), whole.replace(b"X-Page-ID:", b"X-Page-ID")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_streamed_frames_of_other_writers():
    c = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    frame = c.compress(records()[3]) + c.flush()
    assert list(warc.frames(frame)) == [records()[3]]
