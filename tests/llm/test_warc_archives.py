"""WARC writing, reading back and transaction assembly."""

import base64
import gzip
import hashlib
import io
import zlib

import pytest

from buoyline.llm import warc
from buoyline.session import scratch_path


def make(sc, rows):
    return sc.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, digest string")


def brute(rows, least):
    firsts = {}
    for p, _, h in rows:
        h = h or ""
        if p is not None and h in firsts and firsts[h] is not None:
            firsts[h] = min(firsts[h], p)
        elif p is not None or h not in firsts:
            firsts[h] = p if p is not None else firsts.get(h)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        first = firsts[h or ""] if len(raw) >= least else None
        again = first is not None and p != first
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ROWS = [
    (3, "http://a/x", "<p>same</p>"), (1, "http://a/y", "<p>same</p>"), (2, "http://b", None), (4, None, ""), (5, "http://é/ü", "ünï\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
    (6, "http://bad\r\nX: y", "line\nline"), (7, "http://c", "x" * 300_000), (8, "http://c", "x" * 300_000), (9, "http://d", "once"), (9, "http://d", "once"),
    (1, "http://a/y", "<p>same</p>"), (None, "http://n", "<p>same</p>"), (None, "http://n", "only null id"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_and_revisits(sc, least):
    path = warc.write_archive(make(sc, ROWS), scratch_path(sc, "warc"), least)
    got = warc.assemble(warc.read_records(sc, path))
    rows = [(r.metadata.page_id, r.capture.payload_bytes, r.capture.payload_digest, r.capture.type, r.refers_to) for r in got.collect()]
    assert sorted(rows, key=str) == brute(ROWS, least)
    for r in got.collect():
        assert r.capture.valid and r.request.uri == r.capture.uri == r.metadata.uri and r.capture_id == r.capture.record_id


def test_files_are_warc_that_a_plain_reader_walks(sc, tmp_path):
    path = warc.write_archive(make(sc, ROWS), str(tmp_path / "w"))
    kinds = []
    for f in sorted((tmp_path / "w").glob("*.gz")):
        data, at = zlib.decompress(f.read_bytes(), 31), 0
        while at < len(data):
            assert data[at:at + 10] == b"WARC/1.1\r\n"
            head = data[at:data.index(b"\r\n\r\n", at)]
            size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
            kinds.append(head.split(b"WARC-Type: ")[1].split(b"\r\n")[0].decode())
            at += len(head) + 4 + size
            assert data[at:at + 4] == b"\r\n\r\n"
            at += 4
    assert len(kinds) == 3 * len(ROWS) and kinds[0::3] == ["request"] * len(ROWS) and kinds[2::3] == ["metadata"] * len(ROWS)
    assert path


def test_every_other_payload_stays_apart(sc):
    rows = [(i, f"http://h/{i}", f"<html>{i % 40}</html>" * (i % 5)) for i in range(3000)]
    path = warc.write_archive(make(sc, rows).repartition(3), scratch_path(sc, "warc"))
    got = warc.assemble(warc.read_records(sc, path))
    assert sorted([(r.metadata.page_id, r.capture.payload_bytes, r.capture.payload_digest, r.capture.type, r.refers_to) for r in got.collect()], key=str) == brute(rows, 0)


def test_a_payload_that_a_third_of_the_pages_share(sc):
    """Hot payloads and their revisits come from a broadcast, the others and the null key from a spread join."""
    rows = [(i, f"http://h/{i}", "<p>hot</p>" if i % 3 == 0 else f"<p>{i // 4}</p>") for i in range(6000)]
    path = warc.write_archive(make(sc, rows).repartition(3), scratch_path(sc, "warc"))
    got = warc.assemble(warc.read_records(sc, path))
    assert sorted([(r.metadata.page_id, r.capture.payload_bytes, r.capture.payload_digest, r.capture.type, r.refers_to) for r in got.collect()], key=str) == brute(rows, 0)


def test_empty_table(sc):
    path = warc.write_archive(make(sc, []), scratch_path(sc, "warc"))
    assert warc.assemble(warc.read_records(sc, path)).collect() == []


def foreign(kind, block, **headers):
    head = f"WARC/1.0\r\nwarc-type:{kind}\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
    return gzip.compress(f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def test_archives_of_other_writers(sc, tmp_path):
    """One gzip member per record, other spellings of headers, records without digest or page."""
    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n"
    data = b"".join([
        foreign("warcinfo", b"software: x\r\n", WARC_Record_ID="<i>"),
        foreign("response", http + b"body\r\n\r\nmore", WARC_Record_ID="<a>", WARC_Target_URI="http://a"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<q>", WARC_Concurrent_To="<a>"),
        foreign("metadata", b"fetchTimeMs: 3\r\n", WARC_Record_ID="<m>", WARC_Concurrent_To="<a>"),
        foreign("revisit", http, WARC_Record_ID="<r>", WARC_Refers_To="<a>"),
        foreign("response", b"no headers here", WARC_Record_ID="<p>", WARC_Payload_Digest="sha1:WRONG")])
    (tmp_path / "x.warc.gz").write_bytes(data)
    got = {r.capture_id: r for r in warc.assemble(warc.read_records(sc, str(tmp_path))).collect()}
    assert got.keys() == {"<a>", "<r>", "<p>"}
    a, r, p = got["<a>"], got["<r>"], got["<p>"]
    assert (a.capture.payload_bytes, a.capture.valid, a.request.record_id, a.metadata.record_id, a.metadata.page_id) == (12, True, "<q>", "<m>", None)
    assert (r.capture.type, r.capture.payload_bytes, r.capture.payload_digest, r.request) == ("revisit", None, None, None)
    assert (p.capture.payload_bytes, p.capture.valid) == (15, False)
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(gzip.decompress(data)[:-20])))
