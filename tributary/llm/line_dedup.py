"""Line dedup by pairwise alignment.

Lines are hashed. At every line a run begins: the fewest lines in a row that have LEAST_CHARS
characters, so a long line is one and short lines are joined. The first document that holds a run
owns it, and a later document is paired with the owners of its runs: one shared rare run is enough, and
so is one line of PASSAGE_CHARS or of more than PASSAGE_WORDS words however common it is; other common runs have to end on two or more lines
with one owner. So short boilerplate alone pairs nothing, while repeated passages go wherever they are
and large groups of near copies still meet in their first member. Each pair is aligned by patience diff over the line hashes and the aligned common
blocks are deleted from the later document. Exact copies collapse before all this: the whole text of
a later copy is one common block.

A document has no more partners than runs, one a line at most, so the pairs grow with the lines, not with the square of
a group. What is joined and aligned are hashes; whole texts move once, when the lines are deleted.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, bounded_batches, map_rows, written

#: Characters that a run of lines needs to pair documents, and a common block needs to be deleted.
LEAST_CHARS = 30
#: Texts that may share a run for it to count as rare.
RARE = 10
#: A line is a passage of its own, which pairs documents at any frequency, from so many characters on or
#: with more words than this.
PASSAGE_CHARS, PASSAGE_WORDS = 250, 50
#: Bits of the rows that a longest common subsequence keeps at once; longer sequences are halved first.
ROW_BITS = 1 << 28
_MULT = 0x9E3779B97F4A7C15


def _rows(a: list[int], b: list[int]) -> list[int]:
    """After each element of ``a``, the bits of ``b``: 0 where the longest common subsequence with
    what comes before is one shorter."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    out = []
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every beginning of ``b``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of one longest common subsequence, in order."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > ROW_BITS:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return longest_common(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in longest_common(a[half:], b[cut:])]
    rows, out = _rows(a, b), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of two sequences, in order.

    Elements that occur once in both sequences of a range are matched along their longest increasing
    subsequence; matches grow over equal neighbours, and the gaps between them are taken in turn. A
    range without such elements is matched along a longest common subsequence.
    """
    matched: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a: dict[int, int] = {}
        for i in range(a0, a1):
            in_a[a[i]] = -1 if a[i] in in_a else i
        in_b: dict[int, int] = {}
        for j in range(b0, b1):
            in_b[b[j]] = -1 if b[j] in in_b else j
        unique = [(in_a[h], j) for h, j in in_b.items() if j >= 0 and in_a.get(h, -1) >= 0]
        if not unique:
            at_a = [i for i in range(a0, a1) if a[i] in in_b]
            at_b = [j for j in range(b0, b1) if b[j] in in_a]
            matched += [(at_a[i], at_b[j]) for i, j in longest_common([a[i] for i in at_a], [b[j] for j in at_b])]
            continue
        unique.sort(key=lambda x: x[1])
        tails: list[int] = []
        ends: list[int] = []
        before = [-1] * len(unique)
        for k, (i, _) in enumerate(unique):
            p = bisect_left(tails, i)
            before[k] = ends[p - 1] if p else -1
            if p == len(tails):
                tails.append(i)
                ends.append(k)
            else:
                tails[p], ends[p] = i, k
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(unique[k])
            k = before[k]
        chain.reverse()
        at_a, at_b = a0, b0
        for i, j in [*chain, (a1, b1)]:
            if at_a < i and at_b < j:
                work.append((at_a, i, at_b, j))
            if i < a1 and j < b1:
                matched.append((i, j))
            at_a, at_b = i + 1, j + 1
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def common_lines(early: list[int], late: list[int], sizes: list[int], least_chars: int) -> list[int]:
    """Numbers of the later document's lines in common blocks of ``least_chars`` characters or more."""
    out = []
    for _, j, n in patience(early, late):
        if sum(sizes[j : j + n]) >= least_chars:
            out += range(j, j + n)
    return out


def runs(hashes: list[int], sizes: list[int], passages: list[bool], least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the run, hash of its last line, whether that is a passage) of each run of lines, equal
    runs once; a run of one line has its hash."""
    h, n = np.asarray(hashes, np.int64).view(np.uint64), np.asarray(sizes, np.int64)
    sums = np.r_[0, np.cumsum(n)]
    at = np.flatnonzero((n > 0) | (n >= least_chars))
    end = np.maximum(np.searchsorted(sums, sums[at] + least_chars), at + 1)
    at, end = at[end <= len(n)], end[end <= len(n)]

    def powers(x: int) -> np.ndarray:
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(n), x, np.uint64)])

    before = np.r_[np.uint64(0), np.cumsum(h * powers(_MULT)[:-1], dtype=np.uint64)]
    found = ((before[end] - before[at]) * powers(pow(_MULT, -1, 1 << 64))[at]).view(np.int64)
    found, once = np.unique(found, return_index=True)
    return found, h[end - 1].view(np.int64)[once], np.asarray(passages, bool)[end - 1][once]


def removals(documents: DataFrame, least_chars: int = LEAST_CHARS, rare: int | None = RARE) -> DataFrame:
    """(doc_id, key, gone): line numbers to delete by document; gone is null where all lines go.

    Without ``rare`` every shared run pairs a document with its owner, however common it is.

    key is the digest of the text, so rows that share a doc_id but not a text stay apart.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null and text <> ''")
    lines = F.split("text", "\n", -1)

    def passage(x):
        # Words are counted only where the characters can hold so many and do not suffice by themselves.
        n = F.length(F.trim(x))
        return F.when(n <= 2 * PASSAGE_WORDS, False).when(n >= PASSAGE_CHARS, True).otherwise(F.regexp_count(x, F.lit(r"\S+")) > PASSAGE_WORDS)

    lined = rows.select(
        "doc_id",
        F.unhex(F.md5("text")).alias("key"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform(lines, lambda x: F.length(F.trim(x))).alias("sizes"),
        F.transform(lines, passage).alias("passages"),
    )
    lined = written(lined, "lines")
    copies = lined.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.aggregate("sizes", F.lit(0), lambda s, x: s + x)).alias("chars"))
    copies = written(copies, "texts")  # a hot text can be split in a join of two exchanges
    # Rows that repeat go first: a distinct after the join would keep all copies of a hot text in a single task.
    whole = lined.select("doc_id", "key").distinct().join(copies.where("first < last").where(F.col("chars") >= least_chars), "key").where("doc_id > first").select("doc_id", "key", F.lit(None).cast("array<int>").alias("gone"))
    own = written(lined.join(copies.select("key", F.col("first").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["key"]), "first-copies")

    def joined(a: list, n: list, p: list) -> tuple[list, ...]:
        return tuple(map(list, zip(*(runs(*x, least_chars) for x in zip(a, n, p, strict=True)), strict=True))) or ([], [], [])

    longs = pa.list_(pa.int64())
    added = [("line", "array<long>", longs), ("last", "array<long>", longs), ("passage", "array<boolean>", pa.list_(pa.bool_()))]
    each = map_rows(own, ["doc_id"], [F.col("hashes"), F.col("sizes"), F.col("passages")], added, lambda: joined)
    each = each.select("doc_id", F.explode(F.arrays_zip("line", "last", "passage")).alias("l")).select("doc_id", "l.line", F.col("l.last").alias("at"), "l.passage")
    held = each.groupBy("line").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("df")).where("owner < last")
    held = written(held.select("line", "owner", "df"), "shared-lines")
    shared = each.join(held, "line").where("doc_id > owner").groupBy("doc_id", "owner").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.min("df").alias("df"), F.max("passage").alias("passage"))
    pairs = shared if rare is None else shared.where((F.col("df") <= rare) | (F.col("a") < F.col("b")) | F.col("passage"))
    pairs = written(pairs.select("doc_id", "owner"), "line-pairs")
    early = own.select(F.col("doc_id").alias("owner"), F.col("hashes").alias("early"))
    both = pairs.join(own, "doc_id").join(early, "owner")

    def run(a: list, b: list, n: list) -> tuple[list, ...]:
        return ([common_lines(x, y, z, least_chars) for x, y, z in zip(a, b, n, strict=True)],)

    aligned = map_rows(both, ["doc_id", "key"], [F.col("early"), F.col("hashes"), F.col("sizes")], [("gone", "array<int>", pa.list_(pa.int32()))], lambda: run)
    part = aligned.where(F.size("gone") > 0).groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return whole.unionByName(part)


def line_dedup(documents: DataFrame, least_chars: int = LEAST_CHARS, rare: int | None = RARE) -> DataFrame:
    """Rows of ``documents`` with aligned common blocks deleted from ``text``, with n_lines and n_removed.

    A lone short line that more than ``rare`` texts share is boilerplate and stays everywhere; with
    ``rare=None`` it goes from all texts but its owner, at one pair per document and owner of its lines.

    Documents are ordered by doc_id; of rows with equal texts the least doc_id keeps its text, and
    rows that repeat that id keep theirs. A text whose lines all go becomes empty. Null ids, null and
    empty texts stay as they are (n_removed 0). Texts may be of any length; a line that a text repeats
    counts once among the texts that hold it. Other columns stay, save n_lines and n_removed, which
    are replaced. An empty table gives an empty table.
    """
    gone = written(removals(documents, least_chars, rare), "removals").withColumn("hit", F.lit(True))
    keep = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    left = documents.select(*keep).withColumn("__id", F.col("doc_id").cast("long")).withColumn("__key", F.unhex(F.md5(F.col("text").cast("string"))))
    right = gone.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("gone").alias("__gone"), F.col("hit").alias("__hit"))
    # Only the texts that lose lines move to meet their line numbers.
    ids = bounded(written(right.select("__id", "__key").distinct(), "losing"))
    on = ["__id", "__key"]
    same = left.join(ids, on, "left_anti").withColumn("__gone", F.lit(None).cast("array<int>")).withColumn("__hit", F.lit(None).cast("boolean"))
    joined = left.join(ids, on, "left_semi").join(right, on).unionByName(same)
    lines = F.split("text", "\n", -1)

    def between(x, i):
        """Lines after deleted line i - 1 and before deleted line i."""
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(x["gone"], i - 1) + 1)
        stop = F.when(i == F.size(x["gone"]), F.size(x["lines"])).otherwise(F.get(x["gone"], i))
        return F.slice(x["lines"], start + 1, stop - start)

    # The struct is bound once, so a text is split once; the gaps between deleted lines are copied whole.
    bound = F.array(F.struct(lines.alias("lines"), F.array_sort("__gone").alias("gone")))
    lasting = F.get(F.transform(bound, lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["gone"])), lambda i: between(x, i))), "\n")), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    text = F.when(F.col("__hit").isNull(), F.col("text")).when(F.col("__gone").isNull(), F.lit("")).otherwise(lasting)
    removed = F.when(F.col("__hit").isNull(), F.lit(0)).when(F.col("__gone").isNull(), n).otherwise(F.size("__gone")).cast("long")
    return joined.withColumn("n_lines", n).withColumn("n_removed", removed).withColumn("text", text).select(*keep, "n_lines", "n_removed")
