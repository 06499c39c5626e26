from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from loomstat.llm import warc as W
from loomstat.llm.shared import WholeFile


def archive(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    folder = str(tmp_path / "archives")
    files = W.write_archives(pages.repartition(3), folder, **options)
    return folder, [f["name"] for f in files]


def digest(body):
    return base64.b32encode(hashlib.sha1((body or "").encode()).digest()).decode()


ROWS = [(1, "http://a.example/x y", "<p>é</p>"), (2, None, None), (3, "b", ""), (4, "http://c/\r\nX: 1", "same"), (9, "d", "same"),
        (6, "e", "same"), (None, "f", "same"), (7, "g", "long " * 300_000)]


def test_round_trip(spark, tmp_path):
    folder, files = archive(spark, tmp_path, ROWS)
    got = W.assemble(W.read_records(spark, folder, files)).collect()
    assert len(got) == len(ROWS)
    found = {}
    for r in got:
        page = r.metadata.fields["page-id"]
        found[int(page) if page else None] = r
        assert r.request.type == "request" and r.request.concurrent_to == r.response.record_id
    responses = {r.response.record_id: p for p, r in found.items()}
    for page, _, body in ROWS:
        r = found[page].response
        assert r.payload_bytes == len((body or "").encode()) and r.payload_digest == digest(body)
        if page in (4, 6, 2):
            assert r.type == "revisit" and responses[r.refers_to] == {4: 9, 6: 9, 2: 3}[page]
        else:
            assert r.type == "response" and bytes(r.payload) == (body or "").encode() and r.refers_to is None


def test_small_payloads_are_not_revisited(spark, tmp_path):
    folder, files = archive(spark, tmp_path, ROWS, least_revisit=5)
    got = W.read_records(spark, folder, files, payloads=False).where("type = 'revisit'")
    assert got.count() == 0


def record(kind, name, to=None):
    headers = {"WARC-Concurrent-To": to, "Content-Type": "application/http; msgtype=x" if kind != "metadata" else "application/warc-fields"}
    return W.record(kind, name, b"HTTP/1.1 200 OK\r\n\r\nbody" if kind != "metadata" else b"a: 1\r\n", headers)


def test_assembly_follows_identifiers_either_way(spark, tmp_path):
    parts = [record("response", "r1"), record("request", "q1", "r1"), record("metadata", "m1", "q1"),  # over the request
             record("response", "r2", "q2"), record("request", "q2"),  # the response names the request
             record("request", "q3"), record("metadata", "m3", "q3"),  # no response
             record("response", "r4"), record("warcinfo", "w")]
    with WholeFile(str(tmp_path), "plain.warc") as f:
        f.write(b"".join(parts[:4]))
    with WholeFile(str(tmp_path), "packed.warc.gz") as f:
        f.write(gzip.compress(b"".join(parts[4:])))
    got = W.assemble(W.read_records(spark, str(tmp_path), ["plain.warc", "packed.warc.gz"])).collect()
    name = lambda x: x and x.record_id
    assert sorted((str(name(r.response)), str(name(r.request)), str(name(r.metadata))) for r in got) == [
        ("None", "q3", "m3"), ("r1", "q1", "m1"), ("r2", "q2", "None"), ("r4", "None", "None")]


def test_repeated_rows_give_as_many_captures(spark, tmp_path):
    folder, files = archive(spark, tmp_path, [(5, "u", "b")] * 3)
    got = W.assemble(W.read_records(spark, folder, files)).collect()
    assert len(got) == 3 and all(r.response.type == "response" and r.request and r.metadata for r in got)


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.write_archives(pages, str(tmp_path)) == []
    assert W.assemble(W.read_records(spark, str(tmp_path), [])).count() == 0


@pytest.mark.parametrize(("data", "error"), [
    (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", EOFError), (b"nonsense\r\n\r\n", ValueError),
    (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", ValueError)])
def test_damaged_archives_are_refused(data, error):
    with pytest.raises(error):
        list(W.parse(io.BufferedReader(io.BytesIO(data)), True))
