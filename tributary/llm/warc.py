"""WARC archives: a writer with one gzip member per record and a sequential reader.

The reader takes a file in small pieces, inflates member after member with an incremental zlib
object, frames each block by its Content-Length and verifies block and payload digests while the
bytes pass, so it holds one piece of one record, however long files and records are. Archives lie
in the shared folder; each task writes files of its own name and only those named in the committed
manifest are read, so failed and repeated attempts leave nothing behind in the result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, written

PIECE = 1 << 16
#: A new archive begins once one has this many compressed bytes.
ROLL_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, error string"
MANIFEST = "path string, records long, bytes long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9+.-]+:", uri) else (fs.LocalFileSystem(), uri)


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode("ascii")


def sha1_hex(label: str | None) -> str | None:
    """Lower-case hex of a ``sha1:BASE32`` label; none for other labels."""
    if not label or not label.lower().startswith("sha1:"):
        return None
    value = label[5:].strip()
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    clean = ((k, re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", v)) for k, v in headers)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + f"Content-Length: {len(block)}\r\n\r\n"
    tool = zlib.compressobj(6, zlib.DEFLATED, 31)
    return tool.compress(head.encode("utf-8", "surrogatepass")) + tool.compress(block) + tool.compress(b"\r\n\r\n") + tool.flush()


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit of another record without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", uri)] if uri else []
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")] if refers_to else []
    headers += [("Content-Type", "application/http; msgtype=response")]
    headers += [("WARC-Block-Digest", sha1_label(hashlib.sha1(block).digest())), ("WARC-Payload-Digest", sha1_label(hashlib.sha1(payload).digest()))]
    return member(headers, block)


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``records(record_id, target_uri, payload, refers_to)``, one archive or more a partition.

    payload is text or bytes (text: UTF-8; null: empty). A record with refers_to becomes a revisit.
    Returns the committed manifest (path, records, bytes); no rows, no archives. Payloads may be of any
    length; repeated rows are records of their own; a null target_uri is left out; other columns are
    ignored.
    """
    spark = records.sparkSession
    bounded_batches(spark)
    folder = folder or scratch(spark, "warc")
    rows = records.select("record_id", "target_uri", F.col("payload").cast("binary").alias("payload"), "refers_to")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, out, path, count, size = [], None, "", 0, 0
        for pdf in batches:
            for rid, uri, payload, refers in pdf.itertuples(index=False):
                if out is None:
                    path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, at = _store(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size += len(info)
                data = record(rid, uri, payload or b"", refers)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
                    done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return written(rows.mapInPandas(run, MANIFEST), "warc-manifest")


class _Framed:
    """One record as its decompressed bytes arrive: header, block, digests."""

    def __init__(self):
        self.head, self.block, self.left, self.fields = bytearray(), None, 0, {}
        self.http, self.payload_bytes, self.tail = bytearray(), 0, bytearray()
        self.all, self.payload, self.in_payload = hashlib.sha1(), hashlib.sha1(), False

    def feed(self, data: bytes) -> None:
        if self.block is None:
            self.head += data
            cut = self.head.find(b"\r\n\r\n")
            if cut < 0:
                return
            lines = bytes(self.head[:cut]).decode("utf-8", "replace").split("\r\n")
            self.version = lines[0]
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = self.fields.get("content-length", "")
            self.left = int(length) if length.isdigit() else 0
            self.block, data, self.head = True, bytes(self.head[cut + 4 :]), bytearray()
        part, rest = data[: self.left], data[self.left :]
        if part:
            self.left -= len(part)
            self.all.update(part)
            self._payload(part)
        self.tail += rest[:8]

    def _payload(self, part: bytes) -> None:
        if not self.in_payload:
            self.http += part
            cut = self.http.find(b"\r\n\r\n") if "http" in self.fields.get("content-type", "") else -4
            if cut == -1:
                return
            self.in_payload, part = True, bytes(self.http[cut + 4 :])
            del self.http[max(0, cut) :]
        self.payload.update(part)
        self.payload_bytes += len(part)

    def row(self) -> tuple:
        f = self.fields
        kind = f.get("warc-type", "")
        own, size, label = self.payload.hexdigest(), self.payload_bytes, f.get("warc-payload-digest")
        if self.block is None or not self.version.startswith("WARC/"):
            error = "header"
        elif self.left or bytes(self.tail) != b"\r\n\r\n":
            error = "length"
        elif "warc-block-digest" in f and sha1_hex(f["warc-block-digest"]) not in (None, self.all.hexdigest()):
            error = "block digest"
        elif kind != "revisit" and label and sha1_hex(label) not in (None, own):
            error = "payload digest"
        else:
            error = None
        if kind == "revisit":  # the payload is elsewhere: its digest and length are in the headers
            own = sha1_hex(label)
            found = re.search(rb"(?im)^content-length:\s*(\d+)", bytes(self.http))
            size = int(found.group(1)) if found else None
        return (f.get("warc-record-id", "").strip("<>") or None, kind or None, f.get("warc-target-uri"), f.get("warc-refers-to", "").strip("<>") or None, size, own, error)


def read_stream(read: Callable[[int], bytes], piece: int = PIECE) -> Iterator[tuple]:
    """Rows (see RECORDS) of one archive, member by member. A broken member ends it with an error row."""
    data, tool, current = b"", None, None
    while True:
        if not data:
            data = read(piece)
            if not data:
                break
        if tool is None:
            tool, current = zlib.decompressobj(31), _Framed()
        try:
            current.feed(tool.decompress(data, 4 * piece))
        except zlib.error:
            yield (None, None, None, None, None, None, "gzip")
            return
        data = tool.unused_data if tool.eof else tool.unconsumed_tail
        if tool.eof:
            yield current.row()
            tool = None
    if tool is not None:
        yield (None, None, None, None, None, None, "truncated")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives named in ``manifest(path)``: see RECORDS.

    payload_bytes and payload_digest (lower-case hex SHA-1) are of the full payload, for revisits as
    their headers have them. error is null for a sound record; otherwise it names what failed. Records
    are read in pieces, whatever their length; an empty manifest has none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for pdf in batches:
            for path in pdf["path"]:
                store, at = _store(path)
                rows = []
                with store.open_input_stream(at, compression=None) as f:
                    for row in read_stream(f.read):
                        rows.append(row)
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "path")
    return files.mapInPandas(run, RECORDS)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload of ``least_bytes`` or more is that of a page of a larger id."""
    each = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where(f"n >= {int(least_bytes)} and page_id is not null")
    last = each.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    last = written(last.select("digest", "refers_to"), "copied-payloads")  # a hot payload can be split in a join of two exchanges
    return each.join(last, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


_PAGE = "urn:tributary:page:"


def round_trip(pages: DataFrame, least_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` and read the archives back: one row per page.

    Equal payloads of ``least_bytes`` or more are stored once, with the largest page_id; rows that
    repeat that id are all responses. Null html is an empty payload, a null url is left out, a null
    page_id comes back as null. Other columns are ignored; an empty table gives an empty table. A
    record that fails its checks stops the job.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = written(revisits(rows, least_bytes), "revisits")
    sized = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1("html")))
    stored = sized.join(again, ["page_id", "digest"], "left").select(
        F.concat(F.lit(_PAGE), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.col("html").alias("payload"),
        F.concat(F.lit(_PAGE), F.col("refers_to").cast("string")).alias("refers_to"),
    )
    found = read_archives(write_archives(stored, folder)).where("record_type is null or record_type <> 'warcinfo'")
    sound = found.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("WARC record "), F.coalesce("record_id", F.lit("?")), F.lit(": "), F.col("error"))).cast("boolean")))

    def page(c: str):
        return F.expr(f"try_cast(substring({c}, {len(_PAGE) + 1}) as bigint)")

    return sound.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
