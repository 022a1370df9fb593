"""MinHash near-duplicates by an inverted join over signature coordinates.

Every text becomes the set of its five-word shingles and a MinHash signature of K coordinates. Texts
with equal sets collapse to one class first. Classes are posted under each (coordinate, value) pair;
two classes match when at least ``tau`` of their K coordinates collide. Ordered by how common their
pairs are, two matching signatures share a pair among the first K - tau + 1 of each (the prefix), so
only those are merged and the common pairs are skipped. Matches are confirmed on the full sets.

Large posting lists are never expanded into all pairs. First every class in a list is confirmed
against the list's least member only, which links groups of near copies in time linear in their
size. What that leaves apart is compared in blocks of bounded size, where classes already in one
component are skipped and a pair is handled only in the first list that both share. Only links come
out, so a component of m classes yields about m rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, bounded_batches, groups, map_rows, shuffle_partitions, written
from .components import components
from .shingles import WIDTH, WordHashes, minhash, permutations, shingle_hashes

COORDINATES = 32
#: Chance to miss one pair at exactly the similarity asked for.
MISS = 2e-5
#: Members compared with one hub in one sorted run, and shingles (plus 64 a class) in one block.
CHUNK, BLOCK = 512, 400_000

LINK = "a long, b long"


def match_threshold(k: int, percent: int, miss: float = MISS) -> int:
    """The most collisions that a pair at ``percent`` similarity falls short of with chance <= miss."""
    p, below = percent / 100, 0.0
    for tau in range(k):
        below += comb(k, tau) * p**tau * (1 - p) ** (k - tau)
        if below > miss:
            return max(1, tau)
    return k


def sketches(documents: DataFrame, k: int = COORDINATES, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, key, sig) of every row: set size, digest of the set and signature (null: no set)."""

    def make():
        (a, b), cache = permutations(k), WordHashes()

        def run(texts: list[str | None]) -> tuple[list, ...]:
            sets = [shingle_hashes(t, width, cache) for t in texts]
            return (
                [len(h) for h in sets],
                [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets],
                [minhash(h, a, b) if len(h) else None for h in sets],
            )

        return run

    added = [("n", "long", pa.int64()), ("key", "binary", pa.binary()), ("sig", "array<int>", pa.list_(pa.int32()))]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, ["doc_id"], [F.col("text").cast("string")], added, make)


def prefix_postings(reps: DataFrame, k: int, tau: int) -> DataFrame:
    """(posting, rep, mask): the shared postings in each signature's prefix, rarest first.

    Pairs held once rank first and take up prefix places; a signature with fewer than tau shared
    pairs has no match. mask has a bit for each coordinate in the prefix.
    """
    posted = reps.select("rep", F.posexplode("sig").alias("i", "v")).select(
        "rep", (F.col("i").cast("long") * F.lit(1 << 32) + (F.col("v").cast("long") + F.lit(1 << 31))).alias("posting")
    )
    shared = written(posted.groupBy("posting").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared-postings")
    ranked = (
        posted.join(shared, "posting")
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("df", "posting"))).alias("p"))
        .where(F.size("p") >= tau)
        .withColumn("p", F.slice("p", F.lit(1), F.size("p") - F.lit(tau - 1)))
        .withColumn("mask", F.aggregate("p", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x["posting"], 32).cast("int")))))
    )
    return ranked.select("rep", "mask", F.explode("p.posting").alias("posting"))


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def hub_links(postings: DataFrame, sets: DataFrame, tau: int, percent: int) -> DataFrame:
    """Links between the least member of each posting list and the list's others.

    Rows of one hub are dealt out in chunks, each led by the hub's own set, and streamed: no more
    than one batch is held.
    """
    hubs = postings.groupBy("posting").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    pairs = postings.join(written(hubs, "hubs"), "posting").where("rep <> hub").select("hub", "rep").distinct()
    # Only pairs that collide often enough, of sets that are large enough, take their sets along.
    one = sets.select("rep", "n", "sig")
    other = one.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig"))
    hits = F.aggregate(F.zip_with("sig", "hub_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda c, x: c + x)
    near = (hits >= tau) & (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent)
    # No distinct here: it would tie the join to the hub and keep a hot one in a single task.
    pairs = pairs.join(one, "rep").join(other, "hub").where(near).select("hub", "rep")
    pairs = written(pairs.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.lit(1 << 20))), "hub-pairs")
    # Sums are written before they meet the rows they came from: a join of two exchanges can split a hot hub.
    chunks = written(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "hub-chunks")
    members = (
        pairs.join(chunks, "hub")
        .select("hub", "rep", (F.col("chunk") % F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("member"))
        .join(sets.select("rep", "hashes"), "rep")
    )
    lead = (
        chunks.join(sets.select(F.col("rep").alias("hub"), "hashes"), "hub")
        .select("hub", F.col("hub").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("member"), "hashes")
    )
    rows = members.select(*lead.columns).unionByName(lead)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hub = None, None
        for pdf in batches:
            out = []
            for h, rep, chunk, member, data in pdf[["hub", "rep", "chunk", "member", "hashes"]].itertuples(index=False):
                own = np.frombuffer(data, np.uint64)
                if (h, chunk) != at:
                    at, hub = (h, chunk), []
                if not member:
                    hub.append(own)
                elif any(_alike(own, x, percent) for x in hub):
                    out.append((h, rep))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "hub", "chunk").sortWithinPartitions("hub", "chunk", "member")
    return dealt.mapInPandas(run, LINK).distinct()


def block_links(postings: DataFrame, sets: DataFrame, comps: DataFrame, k: int, tau: int, percent: int) -> DataFrame:
    """Links that the hubs left out: lists whose members still lie in several components.

    In each list the members in the hub's component are linked already; the rest is compared with
    them and with itself, block by block.
    """
    own = postings.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    own = own.join(sets.select("rep", "n"), "rep")
    split = own.groupBy("posting").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", "rep").alias("main"))
    split = written(split.where("lo <> hi").select("posting", "main"), "open-postings")
    open_ = written(own.join(split, "posting").withColumn("rest", F.col("comp") != F.col("main")), "open-lists")
    weight = F.col("n") + 64
    blocks = open_.groupBy("posting").agg(
        F.ceil(F.sum(F.when(F.col("rest"), weight).otherwise(0)) / BLOCK).cast("int").alias("rests"),
        F.ceil(F.sum(F.when(F.col("rest"), 0).otherwise(weight)) / BLOCK).cast("int").alias("mains"),
    )
    placed = open_.join(written(blocks, "blocks"), "posting").withColumn("slot", F.pmod(F.xxhash64("rep"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    # Block pairs: (i, j) with i <= j among the rest, then (i, rests + j) for block j of the main side.
    mine = F.transform(F.sequence(F.lit(0), F.col("rests") + F.col("mains") - 1), lambda j: F.struct(F.least(F.col("slot"), j).alias("i"), F.greatest(F.col("slot"), j).alias("j")))
    other = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda i: F.struct(i.alias("i"), (F.col("rests") + F.col("slot")).alias("j")))
    rows = (
        placed.withColumn("pair", F.explode(F.when(F.col("rest"), mine).otherwise(other)))
        .select("posting", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "rep", "comp", "mask", (F.when(F.col("rest"), F.col("slot")).otherwise(F.col("rests") + F.col("slot")) == F.col("pair.i")).alias("left"))
        .join(sets.select("rep", "n", "sig"), "rep")
    )

    def candidates(g: pd.DataFrame) -> list[tuple[int, int]]:
        """Row pairs of one block pair by falling number of collisions."""
        coordinate = int(g["posting"].iloc[0]) >> 32
        sig = np.stack([np.asarray(x, np.int32) for x in g["sig"]])
        bits = (g["mask"].to_numpy(np.int64)[:, None] >> np.arange(k)) & 1 == 1
        comp, n = g["comp"].to_numpy(np.int64), g["n"].to_numpy(np.int64)
        left = g["left"].to_numpy(bool)
        a_rows = left.nonzero()[0]
        b_rows = a_rows if g["i"].iloc[0] == g["j"].iloc[0] else (~left).nonzero()[0]
        found: list[tuple[int, int, int]] = []
        for x in a_rows:
            ys = b_rows[b_rows > x] if b_rows is a_rows else b_rows
            ys = ys[(comp[ys] != comp[x]) & (100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x]))]
            if not len(ys):
                continue
            same = sig[ys] == sig[x]
            hits = same.sum(axis=1)
            first = (same & bits[ys] & bits[x]).argmax(axis=1)
            ok = (hits >= tau) & (first == coordinate)
            found += [(-int(c), int(x), int(y)) for c, y in zip(hits[ok], ys[ok], strict=True)]
        return [(x, y) for _, x, y in sorted(found)]

    block = ["posting", "i", "j"]

    def concerned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, block):
            if (rows_of := sorted({r for pair in candidates(g) for r in pair})):
                yield g.iloc[rows_of]

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, block):
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := parent.get(c, c)) != c:
                    c = up
                return c

            own = [np.frombuffer(x, np.uint64) for x in g["hashes"]]
            reps, comp, out = g["rep"].tolist(), g["comp"].tolist(), []
            for x, y in candidates(g):
                p, q = root(comp[x]), root(comp[y])
                if p != q and _alike(own[x], own[y], percent):
                    parent[max(p, q)] = min(p, q)
                    out.append((reps[x], reps[y]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    n = shuffle_partitions(rows.sparkSession)
    # Signatures alone tell which members have a candidate at all; only those bring their sets.
    few = written(rows.repartition(n, *block).sortWithinPartitions(*block).mapInPandas(concerned, rows.schema), "candidates")
    full = few.join(sets.select("rep", "hashes"), "rep")
    return full.repartition(n, *block).sortWithinPartitions(*block).mapInPandas(confirm, LINK).distinct()


def near_duplicates(documents: DataFrame, percent: int = 80, k: int = COORDINATES, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents(doc_id, text)``.

    Two rows are linked when 100 * |intersection| >= percent * |union| of their sets of distinct
    ``width``-word shingles (A-Z lower-cased, words split at ASCII white space); component_id is the
    least doc_id reachable and kept marks the row that has it. Texts with fewer words are one
    shingle; null, empty and blank texts have an empty set and stay alone. Rows with a null doc_id
    are linked with nothing: component_id null, kept true. Rows that repeat a doc_id count as one
    document with several texts and all come back. Other columns are ignored. An empty table gives
    an empty table.
    """
    bounded_batches(documents.sparkSession)
    tau = match_threshold(k, percent)
    found = written(sketches(documents, k, width), "sketches")
    whole = found.where("key is not null and doc_id is not null")
    classes = whole.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = whole.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["key"])
    reps = written(reps.select(F.col("doc_id").alias("rep"), "n", "sig", "key"), "classes")
    postings = written(prefix_postings(reps, k, tau), "postings")
    need = bounded(written(postings.select("rep").distinct(), "in-postings"))

    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(need, "rep", "left_semi")
    hashed = [("hashes", "binary", pa.binary())]

    def full_sets():
        cache = WordHashes()
        return lambda ts: ([shingle_hashes(t, width, cache).tobytes() for t in ts],)

    sets = map_rows(texts, ["rep"], [F.col("text")], hashed, full_sets).where(F.length("hashes") > 0)
    sets = written(sets.join(reps.select("rep", "n", "sig"), "rep").where("n * 8 = length(hashes)"), "sets")
    hubs = written(hub_links(postings, sets, tau, percent), "hub-links")
    first = components(hubs)
    rest = block_links(postings, sets, first, k, tau, percent)
    label = first.select("node", "comp")

    def to_comp(df: DataFrame, c: str) -> DataFrame:
        return df.join(label.select(F.col("node").alias(c), F.col("comp").alias("_c")), c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")

    second = components(to_comp(to_comp(rest, "a"), "b"))
    up = second.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
    final = first.join(up, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"))
    final = final.unionByName(second.join(first.select("node"), "node", "left_anti").select("node", "comp"))
    # Only classes that differ from their row's own id have to be looked up.
    known = (
        classes.join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", F.coalesce("comp", "rep").alias("component_id"), "copies", "rep")
        .where("copies > 1 or component_id <> rep")
        .select("key", "component_id")
    )
    return (
        found.join(written(known, "component-of"), "key", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
