"""Media columns: Matroska files in a binary column, written and parsed to packet tables.

store_media puts raw 8-bit mono samples into a file: EBML header, segment info, one track, clusters of laced
SimpleBlocks, cues. packets_of walks the elements again and gives one row per frame: track, time, byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import bounded, chunks, tidy, written

# Element identifiers of the Matroska container.
EBML, EBML_VERSION, EBML_READ, EBML_ID_LENGTH, EBML_SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIME_SCALE, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
#: Children of a segment (the others: seek head, tags, chapters, attachments); each ends a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME = 192  # samples, 24 ms at 8 kHz
FRAME_MS = 24
LACED = 8  # frames of a block
BLOCKS = 100  # blocks of a cluster: 19.2 s, within a block's 16-bit relative time


def vint(value: int, width: int = 0) -> bytes:
    """An EBML size: leading zero bits tell the width; all ones is kept for 'unknown'."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The lacing header and the frames of one block."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif kind == EBML_LACING:
        for k, n in enumerate(sizes):
            if k:
                d = n - sizes[k - 1]
                w = next(w for w in range(1, 9) if abs(d) < 1 << 7 * w - 1)
                head += vint(d + (1 << 7 * w - 1) - 1, w)
            else:
                head += vint(n)
    return head + b"".join(frames)


def unlace(data: memoryview, start: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame of a block whose lacing header starts at `start`."""
    if kind == NO_LACING:
        return [(start, end - start)]
    count, at = data[start] + 1, start + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % count:
            raise ValueError("fixed-size lacing does not divide the block")
        sizes = [(end - at) // count] * (count - 1)
    else:
        for k in range(count - 1):
            if kind == XIPH:
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            else:
                value, width = read_vint(data, at)
                n = value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
                at += width
            sizes.append(n)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced sizes exceed the block")
    out = []
    for n in [*sizes, last]:
        out.append((at, n))
        at += n
    return out


def read_vint(data: memoryview, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 8:
        raise ValueError(f"no valid size at {at}")
    return int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1, width


def header(data: memoryview, at: int) -> tuple[int, int, int | None]:
    """Identifier, start of the body and size of the element at `at`; None for an unknown size."""
    width = 9 - data[at].bit_length()
    if width > 4:
        raise ValueError(f"no valid identifier at {at}")
    size, wide = read_vint(data, at + width)
    return int.from_bytes(data[at : at + width], "big"), at + width + wide, None if size == (1 << 7 * wide) - 1 else size


def unknown_end(data: memoryview, ident: int, at: int, end: int) -> int:
    """Where an element of unknown size ends whose body starts at `at`: before what cannot be inside it, or with its parent."""
    ends = {EBML, SEGMENT} | (set() if ident == SEGMENT else TOP)
    while at < end:
        k, body, size = header(data, at)
        if k in ends:
            return at
        at = unknown_end(data, k, body, end) if size is None else body + size
    return at


def elements(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, where it begins, start and end of its body) of each element of a stretch."""
    while at < end:
        ident, body, size = header(data, at)
        stop = unknown_end(data, ident, body, end) if size is None else body + size
        if stop > end:
            raise ValueError(f"the element at {at} ends beyond its parent")
        yield ident, at, body, stop
        at = stop


def write_matroska(payload: bytes) -> bytes:
    """payload: 8-bit samples, a multiple of FRAME."""
    if len(payload) % FRAME:
        raise ValueError(f"the payload is no multiple of {FRAME}")
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ, 1) + number(EBML_ID_LENGTH, 4) + number(EBML_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
    audio = element(AUDIO, element(RATE, struct.pack(">d", 8000.0)) + number(CHANNELS, 1) + number(DEPTH, 8))
    parts = [
        element(INFO, number(TIME_SCALE, 1_000_000) + element(MUXER, b"logmere") + element(WRITER, b"logmere")),
        element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio)),
    ]
    done, points = sum(map(len, parts)), []
    block, cluster = FRAME * LACED, FRAME * LACED * BLOCKS
    for a in range(0, len(payload), cluster):
        time = a // FRAME * FRAME_MS
        body = [number(CLUSTER_TIME, time)]
        for b in range(a, min(a + cluster, len(payload)), block):
            frames = payload[b : b + block]
            count = len(frames) // FRAME
            kind = FIXED if count > 1 else NO_LACING
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b // FRAME * FRAME_MS - time, 0x80 | kind << 1) + (bytes([count - 1]) if count > 1 else b"") + frames))
        points.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, done))))
        parts.append(element(CLUSTER, b"".join(body)))
        done += len(parts[-1])
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(points))]))


def timing(data: memoryview, entry: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """(nanoseconds of a frame or 0, bits a second of PCM samples or 0) of a track's elements."""
    number_of = lambda e, k, other: int.from_bytes(data[slice(*e[k])], "big") if k in e else other
    bits = 0
    if bytes(data[slice(*entry[CODEC])]).startswith(b"A_PCM/") and AUDIO in entry:
        audio = {k: (p, q) for k, _, p, q in elements(data, *entry[AUDIO])}
        rate = bytes(data[slice(*audio[RATE])]) if RATE in audio else b""
        hertz = struct.unpack(">d" if len(rate) == 8 else ">f", rate)[0] if rate else 8000.0
        bits = round(hertz * number_of(audio, CHANNELS, 1) * number_of(audio, DEPTH, 0))
    return number_of(entry, DEFAULT_DURATION, 0), bits


def parse_matroska(raw: bytes) -> dict:
    """{'tracks': {number: codec}, 'packets': int64 array (track, time ms, offset, size), 'cues': [(time, track, cluster)]}; raises ValueError on a broken file."""
    data = memoryview(raw)
    number_at = lambda a, b: int.from_bytes(data[a:b], "big")
    top = list(elements(data, 0, len(data)))
    if [t[0] for t in top] != [EBML, SEGMENT]:
        raise ValueError("not a header and one segment")
    if bytes(next(data[a:b] for i, _, a, b in elements(data, *top[0][2:]) if i == DOC_TYPE)) != b"matroska":
        raise ValueError("another document type")
    base, scale, tracks, packets, cues, clusters, times = top[1][2], 1_000_000, {}, [], [], {}, {}
    for i, begin, a, b in elements(data, *top[1][2:]):
        if i == INFO:
            scale = next((number_at(x, y) for k, _, x, y in elements(data, a, b) if k == TIME_SCALE), scale)
        elif i == TRACKS:
            for _, _, x, y in elements(data, a, b):
                entry = {k: (p, q) for k, _, p, q in elements(data, x, y)}
                tracks[number_at(*entry[TRACK_NUMBER])] = bytes(data[slice(*entry[CODEC])]).decode()
                times[number_at(*entry[TRACK_NUMBER])] = timing(data, entry)
        elif i == CLUSTER:
            time = 0
            for k, _, x, y in elements(data, a, b):
                if k == CLUSTER_TIME:
                    time = clusters[begin - base] = number_at(x, y)
                elif k in (SIMPLE_BLOCK, BLOCK_GROUP):
                    whole = 0
                    if k == BLOCK_GROUP:
                        group = {j: (p, q) for j, _, p, q in elements(data, x, y)}
                        x, y = group[BLOCK]
                        whole = number_at(*group[BLOCK_DURATION]) * scale if BLOCK_DURATION in group else 0
                    track, wide = read_vint(data, x)
                    relative, flags = struct.unpack_from(">hB", data, x + wide)
                    frames = unlace(data, x + wide + 3, y, flags >> 1 & 3)
                    each, bits = times.get(track, (0, 0))
                    for n, (at, size) in enumerate(frames):
                        # later frames of a block: by the track's duration, the block's, or the PCM samples before; else at the block's time
                        after = n * each if each else n * whole // len(frames) if whole else (at - frames[0][0]) * 8_000_000_000 // bits if bits else 0
                        packets.append((track, ((time + relative) * scale + after) // 1_000_000, at, size))
        elif i == CUES:
            for _, _, x, y in elements(data, a, b):
                point = {k: (p, q) for k, _, p, q in elements(data, x, y)}
                place = {k: number_at(p, q) for k, _, p, q in elements(data, *point[CUE_PLACE])}
                cues.append((number_at(*point[CUE_TIME]), place[CUE_TRACK], place[CUE_CLUSTER]))
    if any(clusters.get(at) != time or track not in tracks for time, track, at in cues) or {p[0] for p in packets} - set(tracks):
        raise ValueError("cues or packets do not match clusters and tracks")
    return {"tracks": tracks, "packets": np.array(packets, np.int64).reshape(-1, 4), "cues": cues}


def payload_of(raw: bytes, packets: np.ndarray, track: int = 1) -> bytes:
    data = memoryview(raw)
    return b"".join([data[a : a + n] for t, _, a, n in packets.tolist() if t == track])


def padded(text: str | None) -> bytes:
    """UTF-8, then spaces up to a positive multiple of FRAME."""
    raw = (text or "").encode()
    return raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary). A null text counts as empty; null and repeated ids and texts pass through; equal texts give equal files."""
    kind = docs.schema[id_col].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text_col):
            texts = b.column(text_col).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([write_matroska(padded(t)) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(tidy(store), f"`{id_col}` {kind}, n_bytes long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per frame: id, track, timestamp_ms, offset, size. A null media value has none."""
    kind = media.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in zip(b.column(id_col), b.column("media").to_pylist(), strict=True):
                p = parse_matroska(raw)["packets"] if raw is not None else np.zeros((0, 4), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(p), b.column(id_col).type), *[pa.array(p[:, k]) for k in range(4)]], names=[id_col, "track", "timestamp_ms", "offset", "size"])

    return media.select(id_col, "media").mapInArrow(tidy(walk), f"`{id_col}` {kind}, track long, timestamp_ms long, offset long, size long")


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored bytes back: payload size, digest and tail checksum, the file's size and digest, and a feature string. A null media value gives nulls."""
    kind = media.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value in b.column("media"):  # one file at a time as bytes
                raw = value.as_py()
                if raw is None:
                    out.append((None,) * 6)
                    continue
                parsed = parse_matroska(raw)
                payload = payload_of(raw, parsed["packets"])
                x = np.frombuffer(payload, np.uint8)
                feature = f"{parsed['tracks'][1]} packets={len(parsed['packets'])} cues={len(parsed['cues'])} ms={len(x) // 8} sum={int(x.sum(dtype=np.int64))} peak={int(x.max())} steps={int((x[1:] != x[:-1]).sum())}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(tidy(read), f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    return features(written(store_media(bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")), "media"))
