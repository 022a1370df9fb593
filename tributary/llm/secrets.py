"""Secret scans over recursively decoded layers.

The text itself is the first layer. A worklist takes one layer at a time, scans it, and adds the
layers that decoding it yields: percent escapes, Unicode escapes and character references (the layer
as a whole, so that a secret may begin in plain text and end in an escape), and base64 runs, also
those wrapped into lines, whose bytes may be gzip, zlib, deflate, bzip2 or xz streams. Each character
of a layer carries the span of the text that it came from, so every finding maps back. The worklist
ends at a fixpoint: a layer whose content and place have been seen is not taken again, which also
ends cycles.

Streams are inflated through all their members, piece by piece. A piece ends where no pattern can be
running, so nothing is cut, and only a single run of pattern characters is ever held whole.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows

KINDS = ("assign", "access", "hex")
#: Bytes that a stream is inflated by at a time.
PIECE = 1 << 20

_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(rf"(?:{'|'.join(map(_either_case, _KEYWORDS))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run that is long enough is a whole match, a shorter one fails
_HINTS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: Runs that touch over single line breaks: the first long, the others of any length.
_WRAPPED = tuple(re.compile(rf"(?<!{c}){c}{{16,}}+(?:\r?\n[ \t]*+{c}++)+") for c in ("[A-Za-z0-9+/]", "[A-Za-z0-9_-]"))
_LINE = (re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[A-Za-z0-9_-]+"))
_NO_TEXT = re.compile("[\0-\x08\x0b\x0c\x0e-\x1f\udc80-\udcff]")
#: Every character that a pattern of this module can hold; a piece may end after any other.
_RUNNING = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"' :%\\{}&#;\r\n\t"


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret in one layer, leftmost and not overlapping within a kind."""
    out = []
    if any(h in low for at in range(0, len(text), PIECE) for low in [text[at : at + PIECE + 8].lower()] for h in _HINTS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class _Layer:
    """Text with, for each character, the span of the root text that it stands for."""

    __slots__ = ("text", "start", "end", "via")

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, via: str):
        self.text, self.start, self.end, self.via = text, start, end, via

    @property
    def one_span(self) -> bool:
        """Whether all characters stand for the same span, held once: what came out of a stream."""
        return self.start.strides == self.end.strides == (0,)

    def same_span(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return np.broadcast_to(self.start[0], size), np.broadcast_to(self.end[0], size)


def _is_text(text: str) -> bool:
    bad = 0
    for at in range(0, len(text), PIECE):
        bad += sum(1 for _ in _NO_TEXT.finditer(text, at, at + PIECE))
        if 8 * bad > len(text):
            return False
    return bool(text)


def _is_binary(data: bytes) -> bool:
    """Whether long bytes are no text by :func:`_is_text`, told before all of them are decoded."""
    decoder, bad = codecs.getincrementaldecoder("utf-8")("surrogateescape"), 0
    for at in range(0, len(data) if len(data) > PIECE else 0, PIECE):
        bad += sum(1 for _ in _NO_TEXT.finditer(decoder.decode(data[at : at + PIECE])))
        if 8 * bad > len(data):
            return True
    return False


def _opened(data: bytes, raw: bool = False):
    """A decompressor for the stream that ``data`` begins with, or None."""
    if raw:
        return zlib.decompressobj(-15)
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\0" else None


def _inflated(chunks: Iterator[bytes], raw: bool = False) -> Iterator[bytes]:
    """What the members of a stream inflate to, one after the other and in pieces; then what follows
    them. A broken member ends it; what came out before counts."""
    tool, rest = None, b""
    for chunk in chain(chunks, [None]):
        rest += chunk or b""
        pending = bool(rest)
        while pending and (tool is not None or chunk is None or len(rest) > 5):
            if tool is None and (tool := _opened(rest, raw)) is None:
                yield rest
                yield from (x for x in chunks if x)
                return
            try:
                out = tool.decompress(rest, PIECE)
            except (zlib.error, lzma.LZMAError, OSError, EOFError):
                return
            rest = tool.unused_data if tool.eof else getattr(tool, "unconsumed_tail", b"")
            if out:
                yield out
            pending = bool(rest) or (len(out) >= PIECE and not tool.eof)
            if tool.eof:
                if raw:
                    return
                tool = None


def _raw_stream(data: bytes) -> bool:
    """Whether the bytes are one whole deflate stream without a header."""
    tool, rest = zlib.decompressobj(-15), data
    try:
        while not tool.eof and (rest or rest is data):
            out = tool.decompress(rest, PIECE)
            rest = tool.unconsumed_tail
            if not rest and len(out) < PIECE:
                break
    except zlib.error:
        return False
    return tool.eof and not tool.unused_data


def _pieces(chunks: Iterator[bytes]) -> Iterator[str]:
    """Text of a stream, cut only after characters that no pattern holds."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("surrogateescape"), []
    for chunk in chunks:
        text = decoder.decode(chunk)
        cut = len(text.rstrip(_RUNNING))
        if cut:
            piece, held = "".join([*held, text[:cut]]), []
            yield piece
        held.append(text[cut:])
    last, held = "".join([*held, decoder.decode(b"", True)]), []
    if last:
        yield last


def _from_bytes(data: bytes, start: np.ndarray, end: np.ndarray, via: str) -> Iterator[_Layer]:
    """Layers of bytes that are text, or a stream of it. All of a stream stands for all its bytes."""
    raw = False
    if _opened(data) is None:
        if not _is_binary(data) and _is_text(text := data.decode("utf-8", "surrogateescape")):
            if start.strides == end.strides == (0,):
                start, end = np.broadcast_to(start[0], len(text)), np.broadcast_to(end[0], len(text))
            elif len(text) != len(data):
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
                wide[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
                tails = np.cumsum(wide)
                start, end = start[tails - wide], end[tails - 1]
            yield _Layer(text, start, end, via)
            return
        if not (raw := len(data) > 8 and _raw_stream(data)):
            return
    first, last, chunks = start[0], end[-1], iter([data])
    while True:
        chunks, via = _inflated(chunks, raw), f"{via}>inflate"
        head = next(chunks, None)
        if head is None:
            return
        while len(head) < 6 and (more := next(chunks, None)):
            head += more
        chunks = chain([head], chunks)
        if _opened(head) is None:
            break
        raw = False
    for text in _pieces(chunks):
        if not raw or _is_text(text):
            yield _Layer(text, np.broadcast_to(first, len(text)), np.broadcast_to(last, len(text)), via)


def _replaced(layer: _Layer, pattern: re.Pattern, to_text, via: str) -> _Layer | None:
    """The layer with every match of ``pattern`` decoded in place."""
    parts, starts, ends, at, changed = [], [], [], 0, False
    one = layer.one_span
    for m in pattern.finditer(layer.text):
        got = to_text(m)
        if got is None:
            continue
        text, s, e = got
        changed = True
        parts += [layer.text[at : m.start()], text]
        if not one:
            starts += [layer.start[at : m.start()], layer.start[m.start() + s]]
            ends += [layer.end[at : m.start()], layer.end[m.start() + e]]
        at = m.end()
    if not changed:
        return None
    text = "".join([*parts, layer.text[at:]])
    start, end = layer.same_span(len(text)) if one else (np.concatenate([*starts, layer.start[at:]]), np.concatenate([*ends, layer.end[at:]]))
    return _Layer(text, start, end, f"{layer.via}>{via}" if layer.via else via)


def _percent(m: re.Match):
    data = binascii.unhexlify(m.group().replace("%", ""))
    text = data.decode("utf-8", "surrogateescape")  # a byte that is no UTF-8 is a character of its own
    size = np.array([len(c.encode("utf-8", "surrogateescape")) for c in text])
    tails = np.cumsum(size)
    return text, (tails - size) * 3, tails * 3 - 1


def _escape(m: re.Match):
    digits = next(g for g in m.groups() if g is not None)
    point = int(digits, 10 if m.group(6) else 16)
    if not 0 < point < 0x110000 or 0xD800 <= point < 0xE000:
        return None
    return chr(point), np.array([0]), np.array([m.end() - m.start() - 1])


def _wrapped(places: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Ways to read touching runs as one: all of them, and those of one width with a shorter last
    one, with or without a first one of another width."""
    if len(places) > 1:
        yield places
    sizes = [b - a for a, b in places]
    i = 0
    while i < len(places):
        j = i + 1
        while j < len(places) and sizes[j] == sizes[i]:
            j += 1
        stop = j + (j < len(places) and sizes[j] < sizes[i])
        if stop - i > 1:
            for first in (i - 1, i):
                if first >= 0 and (first, stop) != (0, len(places)):
                    yield places[first:stop]
        i = j


def _unbased(text: str, places: tuple[tuple[int, int], ...], size: int, other: bytes | None) -> Iterator[bytes]:
    """Bytes of the first ``size`` base64 characters that stand in ``places``, at most about a megabyte at a time."""
    held = ""
    for a, b in places:
        for at in range(a, min(b, a + size), PIECE):
            held += text[at : min(b, a + size, at + PIECE)]
            whole = len(held) // 4 * 4
            yield base64.b64decode(held[:whole], altchars=other)
            held = held[whole:]
        size -= min(size, b - a)
    yield base64.b64decode(held + "=" * (-len(held) % 4), altchars=other)


def _decodings(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    if "%" in text:
        if (whole := _replaced(layer, _PERCENT, _percent, "url")) is not None:
            yield whole
        for m in _PERCENT.finditer(text):  # bytes that are no text may be a stream
            data = binascii.unhexlify(m.group().replace("%", ""))
            if _opened(data) is not None:
                at = m.start() + 3 * np.arange(len(data))
                yield from _from_bytes(data, layer.start[at], layer.end[at + 2], f"{layer.via}>url" if layer.via else "url")
    if "\\" in text or "&#" in text:
        if (whole := _replaced(layer, _UNICODE, _escape, "unicode")) is not None:
            yield whole

    def decoded(places: tuple[tuple[int, int], ...], other: bytes | None) -> Iterator[_Layer]:
        size = sum(b - a for a, b in places)
        size -= size % 4 == 1
        try:
            data = b"".join(_unbased(text, places, size, other))
        except (binascii.Error, ValueError):
            return
        if not data:
            return
        via = f"{layer.via}>base64" if layer.via else "base64"
        if layer.one_span:
            yield from _from_bytes(data, *layer.same_span(len(data)), via)
            return
        at = np.concatenate([np.arange(a, b) for a, b in places])
        n = np.arange(len(data))
        yield from _from_bytes(data, layer.start[at[n * 4 // 3]], layer.end[at[np.minimum((n * 8 + 7) // 6, len(at) - 1)]], via)

    done = set()
    for pattern, wrapped, line, other in zip(_BASE64, _WRAPPED, _LINE, (None, b"-_"), strict=True):
        single = ((m.start(), m.start() + len(m.group().rstrip("="))) for m in pattern.finditer(text))
        joined = ([x.span() for x in line.finditer(text, m.start(), m.end())] for m in wrapped.finditer(text)) if "\n" in text else ()
        for (first, last), *more in chain(([x] for x in single), (way for places in joined for way in _wrapped(places))):
            for skip in range(4):  # what stands before an encoded text may touch it
                places = ((first + skip, last), *more)
                if first + skip < last and places not in done:
                    done.add(places)
                    yield from decoded(places, other)


def findings(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, via) of all layers in order of start, kind, end; via is empty for the text itself."""
    if not text:
        return []
    found = {s: "" for s in scan(text)}
    if "%" in text or "\\" in text or "&#" in text or any(p.search(text) for p in _BASE64):
        at = np.arange(len(text), dtype=np.int32)  # a row's text has less than two thousand million characters
        work: list[Iterator[_Layer]] = [iter([_Layer(text, at, at + 1, "")])]
        seen: set[tuple[bytes, int]] = set()
        while work:
            if (layer := next(work[-1], None)) is None:
                work.pop()
                continue
            mark = (xxhash.xxh3_128_digest(layer.text.encode("utf-8", "surrogatepass")), int(layer.start[0]))
            if mark in seen:
                continue
            seen.add(mark)
            for kind, s, e in scan(layer.text) if layer.via else ():
                key = (kind, int(layer.start[s]), int(layer.end[e - 1]))
                was = found.get(key)
                if was is None or (was and layer.via.count(">") < was.count(">")):
                    found[key] = layer.via
            work.append(_decodings(layer))
    order = {k: i for i, k in enumerate(KINDS)}
    return [(*k, via) for k, via in sorted(found.items(), key=lambda x: (x[0][1], order[x[0][0]], x[0][2]))]


def secret_spans(documents: DataFrame) -> DataFrame:
    """doc_id and ``findings`` (kind, start, end, via) of every row of ``documents``.

    Spans are in code points of the row's text, end exclusive; via names the layers that a finding
    was decoded through and is empty for one in the text itself. Null and empty texts have none.
    Every row comes back, repeated ones and null ids too; other columns are ignored. An empty table
    gives an empty table. Texts and what is inflated from them are scanned to their end.
    """
    bounded_batches(documents.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("via", pa.string())]))
    ddl = "array<struct<kind: string, start: int, end: int, via: string>>"
    names = ("kind", "start", "end", "via")

    def run(texts: list[str | None]) -> tuple[list, ...]:
        return ([[dict(zip(names, x, strict=True)) for x in findings(t)] for t in texts],)

    return map_rows(documents.select("doc_id", "text"), ["doc_id"], [F.col("text").cast("string")], [("findings", ddl, kind)], lambda: run)


def span_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``documents``.

    Counts and digest are those of the text itself, ``spans`` joins all, decoded ones too. Null and
    empty texts count 0, have the digest of an empty string and no spans; a text may be of any
    length. Repeated rows and null ids come back as they are, ties between spans fall by start, kind
    and end, other columns are ignored, and an empty table gives an empty table.
    """

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def own(kind: str | None = None):
        return F.filter("findings", lambda x: (x["via"] == "") & (x["kind"] == kind if kind else F.lit(True)))

    count = [F.size(own(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return secret_spans(documents).select("doc_id", *count, F.sha2(joined(own()), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
