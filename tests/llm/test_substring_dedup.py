import hashlib

import numpy as np
import pytest

from tests.llm.conftest import frame
from tributary.llm import queries
from tributary.llm import substring_dedup as S


def brute(rows, length=100):
    """All strings of ``length`` bytes in order of doc_id and start; a row for each distinct id."""
    seen, out = set(), {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        end = 0
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[max(p, end) : p + length] = b"\1" * (p + length - max(p, end))
                end = p + length
            else:
                seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect() if r.doc_id is not None}


def test_against_brute_force(spark, docs, small):
    assert got(queries.op8_bwt_substring_dedup(spark, small)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(edge, edge_rows, nothing):
    out = S.digests(edge)
    assert out.count() == len(edge_rows)
    short = [(d, t) for d, t in edge_rows if len(t or "") < 20_000]
    want, have = brute(short), got(out)
    assert {d: have[d] for d in want} == want
    assert have[7][1] > 0 and have[8][:2] == (have[7][0], have[7][0])  # the long text, and a copy of it
    assert {(r.n_removed, r.n_spans) for r in out.where("doc_id is null").collect()} == {(0, 0)}
    assert S.digests(nothing).count() == 0


@pytest.mark.parametrize("combined, parts", [(S.COMBINED, 1), (1, 1), (S.COMBINED, 2)])
def test_repeated_rows_of_a_unique_text_lose_nothing(spark, monkeypatch, combined, parts):
    monkeypatch.setattr(S, "COMBINED", combined)
    text = " ".join(f"word{i}" for i in range(60))
    out = S.digests(frame(spark, [(1, text), (1, text), (2, "another " + text), (2, "another " + text)]).repartition(parts)).collect()
    assert {(r.doc_id, r.n_removed) for r in out} == {(1, 0), (2, len(text))} and len(out) == 4


def test_periodic_texts_and_zero_bytes(spark):
    rows = [(1, "ab" * 300 + "x" + "ab" * 200), (2, "ab" * 120), (3, "y" * 99), (4, "y" * 100), (5, "y" * 300 + "é" * 200), (6, "\0" * 250), (7, "the of " * 400)]
    assert got(S.digests(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("merged, shard, combined", [(50, 7, 10), (10**6, 10**6, 10**6)])
def test_sizes_of_shards_do_not_matter(spark, monkeypatch, merged, shard, combined):
    for name, value in (("MERGED", merged), ("SHARD", shard), ("COMBINED", combined), ("_PIECE", 256)):
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abcd "), 160)) for _ in range(12)]
    rows = [(i, "".join(p if rng.random() < 0.8 else p[:80] + "!" + p[81:] for p in rng.choice(pool, 4))) for i in range(40)]
    assert got(S.digests(frame(spark, rows))) == brute(rows)


def test_merged_transforms_equal_sorting():
    rng = np.random.default_rng(1)
    m = rng.integers(97, 100, (60, S.LENGTH * 2 - S.GRAM)).astype(np.uint8)
    m[30:] = m[:30]
    m[40:, 20] = 65
    n, width = len(m), S.LENGTH - S.GRAM + 1
    found = S.repeated(m, np.zeros(n, int), np.full(n, width - 1), np.arange(n))
    for offset in range(width):
        c = width - 1 - offset
        seen = set()
        for r in range(n):
            s = m[r, c : c + S.LENGTH].tobytes()
            assert found[r, offset] == (s in seen)
            seen.add(s)


@pytest.mark.parametrize("hot", [1, 3, 20])
def test_hot_anchors_go_string_by_string(spark, docs, hot):
    line = "a line of a licence that stands in very many documents and is long enough to be an anchor "
    rows = [(i, f"{i * 7919 % 1009} words before {line}{i // 3} and others {i * 31 % 7} after it" * 2) for i in range(60)]
    rows += [(r.doc_id + 1000, r.text) for r in docs.limit(60).collect()]
    assert got(S.digests(frame(spark, rows).repartition(4), hot=hot)) == brute(rows)


def test_real_tables_are_merged_from_several_shards(spark):
    merges = spark.sparkContext.accumulator(0)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = S.digests(table, merges=merges)
    assert out.agg({"n_removed": "sum"}).first()[0] > 0
    assert merges.value > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
