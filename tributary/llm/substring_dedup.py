"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

Every string of ``length`` bytes is assigned to one anchor: the gram of least hash among the grams
inside it, leftmost among equals. Equal strings have equal anchors at equal offsets, so only anchors
that occur more than once, with their neighbouring bytes on the string's longer side, need a closer
look; the others cannot be in a repeated string. The strings of one anchor overlap and travel as one
segment; segments meet by the anchor's hash. An anchor that is very common would bring too many of
them together: its strings travel one by one, as digests that meet by the whole string.

Where they meet, segments are aligned at their grams and form shards. Each shard has its own
Burrows-Wheeler transform, the characters before its sorted suffixes column by column. The shards
are merged by refining their interleave one character at a time: distributing it stably by the
transforms' next characters gives the merged order one column further to the left, without sorting
suffixes anew. Longest common prefixes of neighbours follow along by range minima, and a run of
neighbours with a common prefix of ``length`` or more is a repeated interval: all its strings but
the earliest are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, bounded_batches, map_rows, shuffle_partitions, written

LENGTH, GRAM = 100, 32
#: log2 of the bits of the largest filter of repeated anchors that is broadcast (64 MB).
MOST_BITS = 29
#: Segments of a shard, segments merged at once (whole anchors), and segments combined in a map task at once.
SHARD, MERGED, COMBINED = 1024, 65_536, 100_000
#: Occurrences from which on an anchor's strings travel one by one; no group of segments is larger.
HOT = 65_536
_PIECE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _grams(b: np.ndarray) -> np.ndarray:
    """64-bit hash of the 32 bytes at each place, by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _M1
    for s in (1, 2, 4, 8, 16):
        h = (h[:-s] ^ (h[:-s] >> np.uint64(29))) * _M2 + h[s:] * _M1
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place, first string, last string) of each anchor's strings, by side.

    The strings that begin from first to last have the anchor at ``place``. Those that reach further
    to its right are hashed with bytes there, the others with bytes to its left, so a hash stands for
    twice the gram and lies inside every string it stands for. Long texts come in pieces; one anchor
    may come in two.
    """
    width = length - GRAM + 1
    half = width // 2
    b = np.frombuffer(data, np.uint8)
    for s in range(0, len(b) - length + 1, _PIECE):
        part = b[s : s + _PIECE + length - 1]
        h = _grams(part)
        m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        done = 1
        while done < width:
            step = min(done, width - done)
            m = np.minimum(m[:-step], m[step:])
            done += step
        at = (m & _LOW).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[starts[1:], len(at)] - 1
        place = at[starts]
        low, high = place - ends, place - starts
        right, left = low <= half, high > half
        after = h[place[right]] * _M1 ^ h[place[right] + half]
        before = h[place[left]] * _M2 ^ h[place[left] - half - 1]
        keys = np.r_[after ^ (after >> np.uint64(31)), before ^ (before >> np.uint64(29))] * _M1
        where = np.r_[place[right], place[left]] + s
        yield keys.view(np.int64), where, where - np.r_[np.minimum(high[right], half), high[left]], where - np.r_[low[right], np.maximum(low[left], half + 1)]


def shard_transform(m: np.ndarray) -> list[np.ndarray]:
    """Burrows-Wheeler transform of equally long strings by columns: entry c has, in the order of
    the suffixes from column c on, the characters at column c - 1."""
    columns = m.shape[1]
    out: list[np.ndarray] = [np.empty(0, np.uint8)] * (columns + 1)
    order = np.arange(len(m))
    for c in range(columns, 0, -1):
        out[c] = m[order, c - 1]
        order = order[np.argsort(out[c], kind="stable")]
    return out


def _prefixes(old: np.ndarray, order: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours one column further left: 1 + the least between the two, or 0."""
    new = np.zeros(len(old), np.int16)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(chars[b] == chars[a])
    a, b = a[same], b[same]
    least = old[b].copy()
    wide = np.flatnonzero(b - a > 1)
    if len(wide):
        at = np.empty(2 * len(wide), np.int64)
        at[::2], at[1::2] = a[wide] + 1, b[wide] + 1
        least[wide] = np.minimum.reduceat(np.r_[old, 0], at)[::2]
    new[same + 1] = np.minimum(least + 1, 30_000)
    return new


def repeated(m: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings of which rows of ``m`` are also in a row of lesser rank (rows by offsets).

    Row r holds strings from column c = width - 1 - offset on, for offsets low[r] to high[r].
    """
    width = length - GRAM + 1
    columns = m.shape[1]
    bounds = [*range(0, len(m), SHARD), len(m)]
    shards = [shard_transform(m[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    of = np.repeat(np.arange(len(shards)), np.diff(bounds)).astype(np.uint16)
    interleave, rows = of, np.arange(len(m))
    found = np.zeros((len(m), width), bool)
    common = np.zeros(len(m), np.int16)
    huge = np.iinfo(np.int64).max
    for c in range(columns, -1, -1):
        if c == width - 1:  # from here on strings begin: first common prefixes, then they are carried along
            same = m[rows[1:], c:] == m[rows[:-1], c:]
            common[1:] = np.where(same.all(axis=1), columns - c, same.argmin(axis=1))
        if c < width and (deep := common >= length).any():
            heads = np.flatnonzero(~deep)
            offset = width - 1 - c
            held = (low[rows] <= offset) & (offset <= high[rows])
            mine = np.where(held, rank[rows], huge)
            least = np.repeat(np.minimum.reduceat(mine, heads), np.diff(np.r_[heads, len(rows)]))
            found[rows[held & (mine > least)], offset] = True
        if c:
            chars = np.empty(len(m), np.uint8)
            chars[np.argsort(interleave, kind="stable")] = np.concatenate([t[c] for t in shards])
            order = np.argsort(chars, kind="stable")
            if c < width:
                common = _prefixes(common, order, chars)
            interleave, rows = interleave[order], rows[order]
    return found


def _spans(found: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the byte ranges that runs of found strings cover."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return r, place[r] - last, place[r] - first + length


def _merge(g: pd.DataFrame, length: int, tell: Callable[[int], None] | None = None) -> pd.DataFrame:
    """Ranges to remove among segments of whole anchors; g: doc_id, key, place, low, high, segment.

    A digest in a segment's place stands for one string and has equals only. ``tell`` is given the
    number of shards whose transforms are merged.
    """
    g = g.sort_values(["doc_id", "place", "key"], kind="stable", ignore_index=True)
    # Repeated rows of a document are one occurrence.
    g = g[~g.duplicated(["doc_id", "place", "key", "low", "high"])]
    again = g.duplicated(["low", "high", "segment"]).to_numpy()
    twice = g[again]
    out = [pd.DataFrame({"doc_id": twice["doc_id"], "key": twice["key"], "start": twice["place"] - twice["high"], "end": twice["place"] - twice["low"] + length})]
    g = g[~again]
    g = g[g["segment"].str.len() >= length]
    if len(g) > 1:
        if tell:
            tell(-(-len(g) // SHARD))
        width = length - GRAM + 1
        columns = width - 1 + length
        low, high, place = (g[c].to_numpy(np.int64) for c in ("low", "high", "place"))
        data = np.frombuffer(b"".join(g["segment"]), np.uint8)
        sizes = length + high - low
        begins = np.cumsum(sizes) - sizes
        m = np.zeros(len(g) * columns, np.uint8)
        m[np.arange(len(data)) + np.repeat(np.arange(len(g)) * columns + (width - 1 - high) - begins, sizes)] = data
        r, start, end = _spans(repeated(m.reshape(len(g), columns), low, high, np.arange(len(g)), length), place, length)
        out.append(pd.DataFrame({"doc_id": g["doc_id"].to_numpy()[r], "key": g["key"].to_numpy()[r], "start": start, "end": end}))
    return pd.concat(out, ignore_index=True)


def _filter(rows: DataFrame, length: int, hot: int) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Bits of the leading part of every anchor hash that occurs twice, those of the hashes that occur
    more than ``hot`` times (None without any), and the number of bits' log2.

    Both have a fixed largest size. A bit set by another hash lets a segment through that then finds
    no partner, or takes it apart, so a filter that is too full costs time, never results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for t in batch.column(0).to_pylist() for h, *_ in anchors(t, length)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.empty(0, np.int64), pa.int64())], names=["h"])

    twice = rows.select("data").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = written(twice, "anchors")
    counts = twice.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("n") > hot, 1)).alias("hot")).first()
    bits = max(15, min(MOST_BITS, (16 * counts["all"] + 1).bit_length()))

    def bitmap(of: DataFrame) -> np.ndarray:
        place = F.shiftrightunsigned("h", 64 - bits) + 1
        parts = of.select(F.call_function("bitmap_bucket_number", place).alias("b"), F.call_function("bitmap_bit_position", place).alias("p")).groupBy("b").agg(F.call_function("bitmap_construct_agg", F.col("p")).alias("bits"))
        out = np.zeros(1 << (bits - 3), np.uint8)
        for r in parts.toLocalIterator():
            part = np.frombuffer(r.bits, np.uint8)
            out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(part)] = part
        return out

    return bitmap(twice), bitmap(twice.where(F.col("n") > hot)) if counts["hot"] else None, bits


def _has(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    v = h.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(v >> np.uint64(3)).astype(np.int64)] >> (v & np.uint64(7)).astype(np.uint8)) & 1 == 1


def removals(rows: DataFrame, length: int = LENGTH, hot: int | None = None, merges=None) -> DataFrame:
    """(doc_id, key, start, end): byte ranges of rows(doc_id, key, data) that an earlier string covers.

    ``merges`` is an accumulator for the number of shards that were merged with others.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(_filter(rows, length, HOT if hot is None else hot))
    names = ["h", "doc_id", "key", "place", "low", "high", "segment"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary()]
    schema = "h long, doc_id long, key long, place int, low short, high short, segment binary"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of repeated anchors. Equal ones within a task go on as their first; the others
        have an earlier equal and go on without bytes, to be removed."""
        bitmap, common, bits = shared.value
        first: dict[tuple, tuple] = {}
        out: list[tuple] = []

        def batch_of(table: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*table, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def whole() -> Iterator[pa.RecordBatch]:
            """The segments held, those of hot anchors string by string."""
            table = []
            hot_ones = _has(common, np.array([x for x, *_ in first], np.int64), bits).tolist() if common is not None and first else [False] * len(first)
            for ((x, low, high, seg), (d, p, k)), apart in zip(first.items(), hot_ones, strict=True):
                if not apart:
                    table.append((x, d, k, p, low, high, seg))
                for o in range(low, high + 1) if apart else ():
                    digest = xxhash.xxh3_128_digest(seg[high - o : high - o + length] + bytes([o]))
                    table.append((int.from_bytes(digest[:8], "little", signed=True), d, k, p, o, o, digest))
                if len(table) >= 20_000:
                    yield batch_of(table)
                    table = []
            yield batch_of(table)
            first.clear()

        for batch in batches:
            for doc, key, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for h, place, a, b in anchors(data, length):
                    keep = np.flatnonzero(_has(bitmap, h, bits))
                    for x, p, i, j in zip(h[keep].tolist(), place[keep].tolist(), a[keep].tolist(), b[keep].tolist(), strict=True):
                        low, high, segment = p - j, p - i, data[i : j + length]
                        mark, mine = (x, low, high, segment), (doc, p, key)
                        was = first.get(mark)
                        if mine == was:  # the same row again
                            continue
                        if was is None or mine < was:
                            first[mark] = mine
                            mine = was
                        if mine is not None:
                            out.append((x, mine[0], mine[2], mine[1], low, high, None))
                if len(first) >= COMBINED:
                    yield from whole()
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
        yield from whole()
        yield batch_of(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of whole anchors, about MERGED segments each; small batches are gathered first."""

        def blocks() -> Iterator[pd.DataFrame]:
            held: list[pa.RecordBatch] = []
            rest, n = None, 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= MERGED:
                    new = pa.Table.from_batches(held).to_pandas()
                    rest = new if rest is None else pd.concat([rest, new], ignore_index=True)
                    cut = int((rest["h"] != rest["h"].iloc[-1]).to_numpy().nonzero()[0].max(initial=-1)) + 1
                    if cut:
                        yield rest.iloc[:cut]
                    held, rest, n = [], rest.iloc[cut:], 0
            last = [x for x in (rest, pa.Table.from_batches(held).to_pandas() if held else None) if x is not None]
            if last:
                yield pd.concat(last, ignore_index=True)

        for g in blocks():
            done = g["segment"].isna().to_numpy()
            gone = g[done]
            known = pd.DataFrame({"doc_id": gone["doc_id"], "key": gone["key"], "start": gone["place"] - gone["high"], "end": gone["place"] - gone["low"] + length})
            every = pd.concat([known, _merge(g[~done], length, merges.add if merges is not None else None)]) if not done.all() else known
            yield pa.RecordBatch.from_arrays([pa.array(every[c].to_numpy(np.int64)) for c in ranges], names=ranges)

    ranges = ["doc_id", "key", "start", "end"]
    met = rows.select("doc_id", "key", "data").mapInArrow(segments, schema)
    # Rows without bytes need no partner and are dealt out evenly.
    met = met.withColumn("h", F.when(F.col("segment").isNull(), F.xxhash64("doc_id", "place")).otherwise(F.col("h")))
    return met.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h").mapInArrow(merge, "doc_id long, key long, start long, end long")


def substring_dedup(documents: DataFrame, length: int = LENGTH, hot: int | None = None, merges=None) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans of every row of ``documents``.

    A byte is removed if it lies in a string of ``length`` bytes that also begins earlier: in a
    document of smaller doc_id, or earlier in the same one. Strings overlap, are judged on the input
    and never cross documents; texts are UTF-8 bytes, null is empty. Texts under ``length`` bytes
    stay whole, texts of any length are read in pieces. Rows that repeat a doc_id with the same text are one document and come out alike;
    rows with a null doc_id stay whole. Other columns are ignored; an empty table gives an empty
    table.
    """
    bounded_batches(documents.sparkSession, 256)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("key", F.xxhash64("data"))
    long_enough = rows.where(F.col("doc_id").isNotNull() & (F.length("data") >= length))
    gone = removals(long_enough, length, hot, merges)
    ranges = gone.groupBy("doc_id", "key").agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("ranges"))
    ranges = written(ranges, "ranges")
    ids, on = bounded(ranges.select("doc_id", "key")), ["doc_id", "key"]

    def cut(data: list[bytes], ranges: list) -> tuple[list, ...]:
        kept, removed, spans = [], [], []
        for d, each in zip(data, ranges, strict=True):
            parts, end, n = [], 0, 0
            for r in sorted((r["start"], r["end"]) for r in each or ()):
                if r[0] > end or not n:
                    parts.append(d[end : r[0]])
                    n += 1
                end = max(end, r[1])
            kept.append(b"".join([*parts, d[end:]]))
            removed.append(len(d) - len(kept[-1]))
            spans.append(n)
        return kept, removed, spans

    # Only the texts that lose bytes move to meet their ranges.
    sized = rows.withColumn("n_bytes", F.length("data").cast("long"))
    both = sized.join(ids, on, "left_semi").join(ranges, on)
    none = F.lit(0).cast("long")
    same = sized.join(ids, on, "left_anti").select("doc_id", "n_bytes", F.col("data").alias("kept"), none.alias("n_removed"), none.alias("n_spans"))
    added = [("kept", "binary", pa.binary()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64())]
    return map_rows(both, ["doc_id", "n_bytes"], [F.col("data"), F.col("ranges")], added, lambda: cut).unionByName(same)


def digests(documents: DataFrame, length: int = LENGTH, hot: int | None = None, merges=None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left, of every row of ``documents``.

    Nulls, empty and long texts, ties, repeated rows, clashing names and empty tables are as in
    :func:`substring_dedup`; a null text has the digest of no bytes.
    """
    out = substring_dedup(documents, length, hot, merges)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
