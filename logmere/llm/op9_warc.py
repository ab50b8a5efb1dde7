"""WARC archives in Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

Archives are rows (archive, content binary), the shape that the binaryFile source also gives, so archives in
any store that Spark reads can be parsed. Writing keeps each archive near `archive_bytes`.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, joined_by_key, tidy, written

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 100
#: The dictionary is fitted on the first SAMPLE_CHARS of SAMPLE_PAGES pages; it changes sizes, never contents.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 200, 4000, 32 << 10


def fit_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or none where the samples are too few or too small."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record(page_id: int | None, url: str | None, html: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the payload's digest and length but not the payload."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}", "WARC-Truncated: length"]
    else:
        block += html
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block + END


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, from its block headers."""
    head = bytes(data[at : at + 18])
    try:
        params, pos = zstandard.get_frame_parameters(head), at + zstandard.frame_header_size(head)
    except zstandard.ZstdError as e:
        raise ValueError(f"no frame header at {at}: {e}") from e
    while True:
        if pos + 3 > len(data):
            raise ValueError("the archive ends within a frame")
        word = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if word >> 1 & 3 == 1 else word >> 3)
        if word & 1:
            break
    pos += 4 * params.has_checksum
    if pos > len(data):
        raise ValueError("the archive ends within a frame")
    return pos


def records_of(content: bytes) -> Iterator[dict]:
    """The records of an archive; ValueError if a frame, header, length or digest is wrong."""
    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(data[8 : 8 + size])
        if len(raw) < size:
            raise ValueError("the dictionary is cut short")
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        end = frame_end(data, at)
        try:
            raw = reader.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"the frame at {at} cannot be decoded: {e}") from e
        yield parse_record(raw)
        at = end


def parse_record(raw: bytes) -> dict:
    """A record's fields; ids of other archives (uuids, say) give no page_id, and digests that are not SHA-256 in hex are not compared."""
    head, _, rest = raw.partition(END)
    first, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields):
        raise ValueError(f"missing: {sorted(missing)}")
    size = int(fields["content-length"])
    if len(rest) != size + len(END) or not rest.endswith(END):
        raise ValueError("the block's length is not Content-Length")
    http, _, payload = rest[:size].partition(END)
    length = re.search(rb"(?im)^content-length: *(\d+)", http)
    told = int(length[1]) if length else len(payload)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != told or re.fullmatch("[0-9a-f]{64}", digest) and hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload's length or digest is wrong")
    ident = lambda v: int(m[1]) if v and (m := re.fullmatch(r"<urn:page:(-?\d+)>", v)) else None
    return {"page_id": ident(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": told, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": ident(fields.get("warc-refers-to"))}


def write_archives(pages: DataFrame, archive_bytes: int = 4 << 20) -> DataFrame:
    """(archive string, n_records, content binary) of pages (page_id, url, html); other columns are ignored.

    A null html is an empty payload, a null page_id is written as such and is nobody's original, a null url is left
    out. Rows that repeat the smallest page_id of a payload are all responses. An empty table gives no archive.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("html"))
    p = p.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    sample = [bytes(r[0]) for r in p.select(F.substring("html", 1, SAMPLE_CHARS)).limit(SAMPLE_PAGES).collect()]
    dictionary = fit_dictionary([s for s in sample if s])
    firsts = p.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    typed = joined_by_key(p, firsts, "digest", F.col("page_id").cast("string")).withColumn("refers_to", F.expr("CASE WHEN original < page_id OR page_id IS NULL THEN original END")).select("page_id", "url", "html", "size", "digest", "refers_to")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=zdict, write_checksum=True)
        head = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""
        frames, size, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:06d}.warc.zst"]), pa.array([len(frames)], pa.int64()), pa.array([head + b"".join(frames)], pa.binary())], names=["archive", "n_records", "content"])

        for b in chunks(batches, "html"):
            for row in zip(*[b.column(k).to_pylist() for k in range(6)], strict=True):
                frames.append(writer.compress(record(*row)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield flush()
                    frames, size, number = [], 0, number + 1
        if frames:
            yield flush()

    return typed.mapInArrow(tidy(archive), "archive string, n_records long, content binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if wanted."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows: list[dict] = []
                size = 0
                for r in records_of(content.as_py()):
                    rows.append(r)
                    size += len(r["payload"])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names=names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names=names)

    return archives.select("content").mapInArrow(tidy(read), schema)


def query(spark, sf_dir: str) -> DataFrame:
    archives = written(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "archives")
    return read_archives(archives, payloads=False).drop("url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original < page_id THEN original END AS refers_to
FROM f
"""
