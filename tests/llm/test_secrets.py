import base64
import bz2
import gzip
import hashlib
import lzma
import re
import tracemalloc
import urllib.parse
import zlib

import pytest

from tributary.llm import queries, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    count = [sum(x[3] == k for x in spans) for k in secrets.KINDS]
    return (*count, hashlib.sha256(joined.encode()).hexdigest())


def test_base_spans(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.op5_secret_scan(spark, folder).collect()}
    assert got == {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sum(x[0] + x[1] + x[2] for x in got.values()) > 0


def test_edges(edge, edge_rows, nothing):
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.span_digests(edge).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in edge_rows), key=str)
    assert secrets.span_digests(nothing).count() == 0


TRICKY = ["token=token:abcdefghij", "secret=token=abcdefgh", "PassWord : 'abc.defgh'", "paſsword=abcdefghij", "AKIAAKIAAKIAAKIA", "AKIA" + "B" * 11, "a" * 32 + "A" + "b" * 31, "api_key=x apikey=12345678", ""]


@pytest.mark.parametrize("text", TRICKY)
def test_base_matches_fail_and_consume_as_defined(text):
    found = [(k, s, e) for k, s, e, via in secrets.findings(text) if not via]
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
    assert hashlib.sha256(joined.encode()).hexdigest() == brute(text)[3]


PLAIN = 'password = "abcdefgh123"'
B64 = base64.b64encode(PLAIN.encode()).decode()


@pytest.mark.parametrize(
    "hidden, via",
    [
        (B64, "base64"),
        (base64.urlsafe_b64encode(b"\xc3\xbf\xc3\xbf?>" + PLAIN.encode()).decode(), "base64"),
        (base64.b64encode(B64.encode()).decode(), "base64>base64"),
        (base64.b64encode(gzip.compress(PLAIN.encode())).decode(), "base64>inflate"),
        (base64.b64encode(zlib.compress(gzip.compress(PLAIN.encode()))).decode(), "base64>inflate>inflate"),
        (urllib.parse.quote(PLAIN), "url"),
        (urllib.parse.quote(urllib.parse.quote(PLAIN)), "url>url"),
        ("".join(f"\\u{ord(c):04x}" for c in PLAIN), "unicode"),
        ("".join(f"&#{ord(c)};" for c in PLAIN), "unicode"),
        ("".join(f"%{b:02X}" for b in zlib.compress(PLAIN.encode())), "url>inflate"),
    ],
)
def test_layers_are_unwrapped_and_mapped(hidden, via):
    text = f"é {hidden} ü"
    found = [f for f in secrets.findings(text) if f[0] == "assign" and f[3]]
    assert found and found[0][3] == via
    assert 2 <= found[0][1] < found[0][2] <= 2 + len(hidden)
    assert not [f for f in secrets.findings("é x ü") if f[3]]


def test_secret_that_begins_in_plain_text():
    text = "see password%3Dabcdefghij now"
    assert [(s, e) for _, s, e, via in secrets.findings(text) if via == "url"] == [(4, 25)]


def test_same_layer_twice_and_cycles_end():
    text = f"{B64} {B64}"
    assert len([f for f in secrets.findings(text) if f[0] == "assign"]) == 2
    deep = PLAIN
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert [f for f in secrets.findings(deep) if f[0] == "assign"]


def wrap(data, width=76, indent=""):
    run = base64.b64encode(data).decode()
    return f"\n{indent}".join(run[i : i + width] for i in range(0, len(run), width))


FILLER = "".join(f"{i},{i * i % 977};" for i in range(400))
RAW = zlib.compressobj(9, zlib.DEFLATED, -15)
RAW = RAW.compress(PLAIN.encode()) + RAW.flush()


@pytest.mark.parametrize(
    "hidden",
    [
        base64.b64encode(gzip.compress(b"nothing in here") + gzip.compress(PLAIN.encode())).decode(),
        base64.b64encode(RAW).decode(),
        base64.b64encode(bz2.compress(PLAIN.encode())).decode(),
        base64.b64encode(lzma.compress(PLAIN.encode())).decode(),
        base64.b64encode(gzip.compress((FILLER + PLAIN).encode())[:-9]).decode(),  # cut off
        base64.b64encode(b"caf\xe9 au lait, " + PLAIN.encode()).decode(),
        wrap(("x" * 50 + PLAIN + " y" * 40).encode()),
        wrap(gzip.compress((FILLER + PLAIN).encode()), 64),
        wrap(gzip.compress((FILLER + PLAIN).encode()), 64, "    "),
        "internationalisms\n" + wrap(gzip.compress((FILLER + PLAIN).encode()), 64),
        "first%FFpassword%3Dabcdefgh1",
    ],
)
def test_layers_that_are_not_whole_or_plain(hidden):
    text = f"é {hidden} ü"
    found = [f for f in secrets.findings(text) if f[0] == "assign" and f[3]]
    assert found and 2 <= found[0][1] < found[0][2] <= 2 + len(hidden)


@pytest.mark.parametrize("piece", [secrets.PIECE, 1000, 37])
def test_streams_are_scanned_to_their_end(monkeypatch, piece):
    monkeypatch.setattr(secrets, "PIECE", piece)
    noise = ", ".join(str(i * 7919 % 10007) for i in range(20_000))
    for inner in (PLAIN, base64.b64encode(PLAIN.encode()).decode(), f"{'a' * 3000}{PLAIN}"):
        body = f"{noise}, {inner}, {noise}".encode()
        for packed in (gzip.compress(body), bz2.compress(body), lzma.compress(body), zlib.compress(gzip.compress(body))):
            text = base64.b64encode(packed).decode()
            assert [(k, s, e) for k, s, e, via in secrets.findings(text) if k == "assign"] == [("assign", 0, len(text.rstrip("=")))]


def test_more_is_inflated_than_is_held():
    body = b"no secret in this line, " * 6_000_000 + PLAIN.encode()
    assert [f[0] for f in secrets.findings(base64.b64encode(zlib.compress(body)).decode())] == ["assign"]


@pytest.mark.parametrize("before", ["a", "ab", "abc", "abcd", "QUJD+/x"])
@pytest.mark.parametrize("wrapped", [False, True])
def test_base64_that_touches_what_stands_before_it(before, wrapped):
    encoded = base64.b64encode((PLAIN + " " * 30).encode()).decode()
    body = encoded if not wrapped else encoded[:40] + "\n" + encoded[40:]
    found = [x for x in secrets.findings(f"see {before}{body} end") if x[3] == "base64"]
    assert [k for k, *_ in found] == ["assign"]
    _, start, end, _ = found[0]
    assert 4 + len(before) <= start + 1 and end <= 4 + len(before) + len(body)


def test_one_long_run_of_a_stream_is_held_a_few_times_at_most():
    size = 24 << 20
    text = base64.b64encode(gzip.compress(b"a" * size + b" " + PLAIN.encode(), 9)).decode()
    secrets.findings(text[:100])
    tracemalloc.start()
    found = secrets.findings(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(k, via) for k, _, _, via in found} == {("assign", "base64>inflate"), ("hex", "base64>inflate")}
    assert peak < 4 * size
