import gzip
import hashlib
import io

import pytest

from tributary.llm import queries, warc


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) by grouping payloads."""
    last = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= 1000:
            last[b] = max(last.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        to = last.get(b) if p is not None else None
        again = to is not None and to != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query(spark, small):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert got(queries.op4_warc_round_trip(spark, small)) == brute(rows)


def test_edges(spark):
    rows = [
        (1, "u", "x" * 1500), (2, None, "x" * 1500), (3, "a\r\nWARC-Type: b", "x" * 1500), (4, "u", "y"), (5, "u", "y"), (6, "u", None), (None, "u", "q" * 2000), (9, "u", "q" * 2000),
        (7, "u", "é" * 600), (8, "u", "é" * 600), (8, "u", "é" * 600), (10, "u", "\r\n\r\n" * 400), (11, "u", "z" * 300_000), (12, "u", "x" * 999), (13, "u", "x" * 999),
    ]
    df = spark.createDataFrame([(*r, "k", "d") for r in rows], "page_id long, url string, html string, digest string, refers_to string").repartition(4)
    assert got(warc.round_trip(df)) == brute(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def archive():
    return b"".join(warc.record(f"urn:x:{i}", "http://a/", b"payload %d " % i * 50, None) for i in range(3)) + warc.record("urn:x:9", None, b"payload 0 " * 50, "urn:x:0")


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_reader_takes_any_pieces(piece):
    rows = list(warc.read_stream(io.BytesIO(archive()).read, piece))
    assert [r[0] for r in rows] == ["urn:x:0", "urn:x:1", "urn:x:2", "urn:x:9"] and not any(r[6] for r in rows)
    assert rows[3][1] == "revisit" and rows[3][3] == "urn:x:0" and rows[3][4:6] == rows[0][4:6]


def test_reader_finds_what_is_broken():
    def errors(data):
        return [r[6] for r in warc.read_stream(io.BytesIO(data).read)]

    assert errors(b"") == []
    assert errors(archive()[:-9])[-1] == "truncated"
    assert errors(archive()[:40] + b"\0\0\0\0" + archive()[44:])[0] in ("gzip", "header", "length", "block digest")
    plain = gzip.decompress(warc.record("urn:x:1", None, b"abc", None))
    assert errors(gzip.compress(plain.replace(b"abc", b"abd"))) == ["block digest"]
    assert errors(gzip.compress(plain.replace(b"\r\n\r\nabc", b"\r\n\r\nabcd"))) == ["length"]
    assert errors(gzip.compress(b"no record")) == ["header"]


def test_files_are_ordinary_gzip(spark, tmp_path):
    df = spark.createDataFrame([("urn:x:1", "http://a/", "text", None)], "record_id string, target_uri string, payload string, refers_to string")
    made = warc.write_archives(df, str(tmp_path / "w"))
    path = made.first().path
    text = gzip.open(path, "rt", newline="").read()
    assert text.count("WARC/1.1\r\n") == 2 and text.endswith("text\r\n\r\n")
    (tmp_path / "w" / "left-over.warc.gz").write_bytes(b"junk")  # of a failed attempt: not in the manifest
    assert warc.read_archives(made).where("error is not null").count() == 0
