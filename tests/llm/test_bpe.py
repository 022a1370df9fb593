import functools
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import bpe, queries

PATH = P.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.read_ranks(PATH)), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


def test_hash_is_perfect_and_minimal(codec):
    assert sorted(codec.hash.find(codec.words)) == list(range(len(codec.words)))
    assert codec.hash.find([b"no such word at all", b""]) == [-1, -1]
    assert bpe.PerfectHash([]).find([b"x"]) == [-1] and bpe.PerfectHash([b"x"]).find([b"x", b"y"]) == [0, -1]


@functools.cache
def _tools():
    return bpe.codec(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.read_ranks(PATH)), special_tokens={})


@given(st.text(max_size=60) | st.text(alphabet="ab \n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_the_library(text):
    c, r = _tools()
    text = text.encode("utf-8", "ignore").decode()
    ids = c.ready().encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == r.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


def test_query_and_edges(spark, docs, small, codec, reference, edge, edge_rows, nothing, monkeypatch):
    def want(text):
        ids = reference.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_byte_bpe(spark, small).collect()}
    assert got == {r.doc_id: want(r.text) for r in docs.collect()}
    monkeypatch.setattr(bpe, "PIECE", 1000)
    rows = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(edge, codec).collect())
    assert rows == sorted((str(d), *want(t)) for d, t in edge_rows)
    out = bpe.encode(edge, codec)
    assert set(out.columns) == set(edge.columns) and out.where("size(ids) <> n_tokens").count() == 0
    assert bpe.decode(bpe.encode(nothing, codec), codec).count() == 0


def test_large_vocabularies_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 10)
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError, match="not broadcast"):
        bpe.read_ranks(str(tmp_path / "v"))
