"""Archives that are damaged or not our own: wrong frames, headers, lengths and digests are told, foreign ids are read."""

import hashlib
import struct

import pytest
import zstandard

pytest.importorskip("logmere.llm")
from logmere.llm import op9_warc as W

HTML = b"<p>a page of some length</p>" * 9


def archive(*records, dictionary=b""):
    head = struct.pack("<II", W.DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""
    writer = zstandard.ZstdCompressor(write_checksum=True)
    return head + b"".join(map(writer.compress, records))


def own(page=1, digest=None, refers=None):
    return W.record(page, "http://a/b c", HTML, len(HTML), digest or hashlib.sha256(HTML).hexdigest(), refers)


def test_records():
    got = list(W.records_of(archive(own(1), own(2, refers=1))))
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got] == [(1, "response", None, len(HTML)), (2, "revisit", 1, len(HTML))]
    assert got[0]["payload"] == HTML and got[0]["url"] == "http://a/b%20c" and list(W.records_of(b"")) == []


def test_foreign_record():
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0-1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (got,) = W.records_of(archive(raw))
    assert got["page_id"] is None and got["record_type"] == "warcinfo"


@pytest.mark.parametrize("bad", [
    archive(own())[:-5], archive(own()) + b"junk", archive(own(digest="0" * 64)), archive(own().replace(b"Content-Length", b"Content-Width")),
    archive(own()[:-4]), archive(b"HTTP/1.1 200 OK"), struct.pack("<II", W.DICTIONARY_FRAME, 99) + b"short",
])
def test_damaged(bad):
    with pytest.raises(ValueError):
        list(W.records_of(bad))
