"""Small Matroska files: clusters of unknown size, and the times of laced frames."""

import hashlib
import struct
import zlib

import pytest

pytest.importorskip("logmere.llm")
from compare import duck

from logmere.llm import op10_matroska as M
from logmere.llm.queries import QUERIES

UNKNOWN = b"\x01" + b"\xff" * 7


def streamed(ident, body):
    return ident.to_bytes(4, "big") + UNKNOWN + body


def block(relative, frames):
    return b"\x81" + struct.pack(">hB", relative, 0x80 | M.XIPH << 1) + M.lace(frames, M.XIPH)


def media(clusters, duration=None, codec=b"A_OPUS", segment=M.element):
    track = M.number(M.TRACK_NUMBER, 1) + M.element(M.CODEC, codec) + (M.number(M.DEFAULT_DURATION, duration) if duration else b"")
    head = M.element(M.EBML, M.element(M.DOC_TYPE, b"matroska"))
    return head + segment(M.SEGMENT, M.element(M.TRACKS, M.element(M.TRACK, track)) + clusters)


def times(raw):
    return [(r[1], raw[r[2] : r[2] + r[3]]) for r in M.parse_matroska(raw)["packets"].tolist()]


def test_unknown_clusters():
    parts = [M.number(M.CLUSTER_TIME, t) + M.element(M.SIMPLE_BLOCK, block(5, [b"a%d" % t, b"b"])) for t in (0, 1000, 2000)]
    want = [(t + d, f) for t in (0, 1000, 2000) for d, f in ((5, b"a%d" % t), (25, b"b"))]
    tags = M.element(0x1254C367, b"")
    for segment in (M.element, streamed):
        raw = media(streamed(M.CLUSTER, parts[0]) + streamed(M.CLUSTER, parts[1]) + tags + M.element(M.CLUSTER, parts[2]), 20_000_000, segment=segment)
        assert times(raw) == want
    with pytest.raises(ValueError):
        M.parse_matroska(raw + raw)


def test_laced_times():
    frames = [b"x" * 10, b"y" * 20, b"z"]
    at = lambda raw: [t for t, _ in times(raw)]
    cluster = lambda body: M.element(M.CLUSTER, M.number(M.CLUSTER_TIME, 100) + body)
    simple = cluster(M.element(M.SIMPLE_BLOCK, block(0, frames)))
    group = cluster(M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block(0, frames)) + M.number(M.BLOCK_DURATION, 90)))
    assert at(media(simple, 20_000_000)) == [100, 120, 140]
    assert at(media(group)) == [100, 130, 160]
    assert at(media(simple)) == [100, 100, 100]  # no duration is known


def test_own_files_keep_their_times():
    raw = M.write_matroska(bytes(range(192)) * 20)
    assert [t for t, _ in times(raw)] == [24 * n for n in range(20)]


def test_query_against_sql_and_digests(spark, sf):
    pad = "greatest(192, (strlen(t) + 191) // 192 * 192)"
    sql = f"SELECT doc_id, strlen(t), {pad}, sha256(t || repeat(' ', ({pad} - strlen(t))::BIGINT)), t FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
    want = {r[0]: r[1:] for r in duck(sf).execute(sql).fetchall()}
    got = QUERIES["op10_media_columns"](spark, sf).collect()
    assert len(got) == len(want)
    files = {}
    for r in got:
        size, padded, digest, text = want[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (size, padded, digest)
        payload = text.encode() + b" " * (padded - size)
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_bytes"] > padded
        steps = sum(a != b for a, b in zip(payload, payload[1:], strict=False))
        assert f"packets={padded // 192} " in r["feature"] and r["feature"].endswith(f"ms={padded // 8} sum={sum(payload)} peak={max(payload)} steps={steps}")
        files.setdefault(text, (r["media_bytes"], r["media_sha256"], r["feature"]))
        assert files[text] == (r["media_bytes"], r["media_sha256"], r["feature"])
    some = M.write_matroska(M.padded(got[0]["feature"]))
    assert hashlib.sha256(M.payload_of(some, M.parse_matroska(some)["packets"])).hexdigest() == hashlib.sha256(M.padded(got[0]["feature"])).hexdigest()


def test_null_media(spark):
    media = spark.createDataFrame([(1, 0, None), (None, 3, bytearray(M.write_matroska(M.padded("abc"))))], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: r for r in M.features(media).collect()}
    assert rows[1]["media_sha256"] is None and rows[None]["payload_bytes"] == 192
    assert M.packet_table(media).count() == 1
    assert M.features(media.limit(0)).count() == 0
