"""Byte-level BPE by two-tier lookup.

A text is cut into pre-tokens by the tokenizer's pattern. Tier one is a minimal perfect hash over
the vocabulary: it resolves every pre-token that is a vocabulary entry as a whole, many at a time.
Tier two takes the misses: a heap of mergeable pairs over a doubly linked list of bytes, lowest rank
first, leftmost first among equals.

The vocabulary is a file of fixed size, read on the driver and broadcast; a check of its size keeps
it so.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows

#: Vocabularies larger than this are refused rather than broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens of a generation that a task remembers, and tokens of one text handled at once.
MEMO, PIECE = 150_000, 200_000
_KEYS_PER_BUCKET = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys, n slots, one displacement a bucket.

    Buckets of several keys, largest first, get the first displacement that sends their keys to free
    slots; a bucket of one key names its slot. A lookup hashes, reads one displacement and compares
    the stored key, so strings outside the set are told apart exactly.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // _KEYS_PER_BUCKET)
        h = self._hash(keys)
        order = np.argsort(h % np.uint64(self.buckets), kind="stable")
        of = (h[order] % np.uint64(self.buckets)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if n else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, n])
        self.displacement = np.zeros(self.buckets, np.int64)
        slot_of = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        spare: Iterator[int] | None = None
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[starts[b] : starts[b] + sizes[b]]
            bucket = of[starts[b]]
            if sizes[b] > 1:
                d = 0
                while True:  # sixteen displacements at a time
                    tried = self._slots(h[mine][None, :], np.arange(d, d + 16, dtype=np.uint64)[:, None])
                    fits = [i for i in np.flatnonzero(free[tried].all(axis=1)).tolist() if len(set(tried[i].tolist())) == len(mine)]
                    if fits:
                        break
                    d += 16
                slots = tried[fits[0]]
                self.displacement[bucket] = d + fits[0]
            else:
                spare = spare or iter(np.flatnonzero(free).tolist())
                slots = np.array([next(spare)])
                self.displacement[bucket] = -1 - slots[0]
            slot_of[mine] = slots
            free[slots] = False
        self.keys: list[bytes] = [b""] * n
        self.index = np.empty(n, np.int64)
        for k, s in enumerate(slot_of):
            self.keys[s] = keys[k]
            self.index[s] = k

    @staticmethod
    def _hash(keys: Iterable[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * _ODD)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(self.n)).astype(np.int64)

    def find(self, words: list[bytes]) -> list[int]:
        """Index of each word among the keys, -1 if it is none."""
        if not words or not self.n:
            return [-1] * len(words)
        h = self._hash(words)
        d = self.displacement[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(d < 0, -1 - d, self._slots(h, np.maximum(d, 0).astype(np.uint64)))
        keys, index = self.keys, self.index
        return [int(index[s]) if keys[s] == w else -1 for s, w in zip(slots.tolist(), words, strict=True)]


class Memo:
    """Pre-tokens with their packed ids in two generations: what is used stays, the rest goes."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def room(self) -> dict[str, bytes]:
        if len(self.new) > MEMO:
            self.new, self.old = {}, self.new
        return self.new


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(bytes, rank) lines of a rank file: base64, space, number."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary over {MAX_VOCABULARY_BYTES} bytes is not broadcast")
    return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in data.splitlines() if line.strip())]


class Codec:
    """Encoder and decoder over one vocabulary; the parts that a task needs and nothing else."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.words, self.ids = [w for w, _ in ranks], [r for _, r in ranks]
        self.hash, self.pattern = PerfectHash(self.words), pattern

    def ready(self) -> Codec:
        """Built once in each worker from the broadcast parts."""
        if not hasattr(self, "rank"):
            self.rank = dict(zip(self.words, self.ids, strict=True))
            self.bytes_of = {r: w for w, r in self.rank.items()}
            self.cut = regex.compile(self.pattern)
        return self

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: ids of one pre-token by heap merges over linked bytes.

        An entry of the heap is rank * n + place, so the lowest rank comes first and the leftmost
        among equals; it counts only while the pair at its place still has that rank.
        """
        n, find, push, pop = len(piece), self.rank.get, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))  # part i covers piece[i:end[i]]; end is also the next part
        before = list(range(-1, n - 1))
        pair = [find(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(pop(heap), n)
            if pair[i] != r:
                continue
            j = end[i]
            stop = end[i] = end[j]
            pair[j] = -1
            if stop < n:
                before[stop] = i
                r = pair[i] = find(piece[i : end[stop]], -1)
                if r >= 0:
                    push(heap, r * n + i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                r = pair[p] = find(piece[p:stop], -1)
                if r >= 0:
                    push(heap, r * n + p)
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i : end[i]]])
            i = end[i]
        return out

    def _learn(self, tokens: set[str], memo: Memo) -> dict[str, bytes]:
        known = memo.room()
        todo = []
        for t in tokens.difference(known):
            if (was := memo.old.get(t)) is not None:
                known[t] = was
            else:
                todo.append(t)
        raw = [t.encode("utf-8", "surrogatepass") for t in todo]
        for t, w, k in zip(todo, raw, self.hash.find(raw), strict=True):
            ids = [self.ids[k]] if k >= 0 else self.merge(w)
            known[t] = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def encode(self, text: str | None, memo: Memo | None = None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; ``memo`` is what a task has learned so far."""
        memo = memo or Memo()
        if not text:
            return b""
        if len(text) <= PIECE:
            pieces: Iterable[list[str]] = (self.cut.findall(text),)
        else:
            found = (m.group() for m in self.cut.finditer(text))
            pieces = iter(lambda: list(islice(found, PIECE)), [])
        out = []
        for tokens in pieces:
            known = self._learn(set(tokens), memo)
            out.append(b"".join(map(known.__getitem__, tokens)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _shared(df: DataFrame, tokenizer: Codec):
    return df.sparkSession.sparkContext.broadcast(tokenizer)


def encode(documents: DataFrame, tokenizer: Codec, text: str = "text", packed: bool = False, check: bool = False) -> DataFrame:
    """Rows of ``documents`` with ``ids`` and ``n_tokens``.

    ids is array<int>, or with ``packed`` the same as little-endian unsigned 32-bit integers. With
    ``check`` the ids are decoded again at once and a text they do not give back is an error. Null
    and empty texts have no tokens. Every row comes back, repeated ones too; other columns stay as
    they are, save ``ids`` and ``n_tokens``, which are replaced. An empty table gives an empty table.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(tokenizer)
    kind = ("ids", "binary", pa.binary()) if packed else ("ids", "array<int>", pa.list_(pa.int32()))

    def make():
        tool, memo = shared.value.ready(), Memo()

        def run(texts: list[str | None]) -> tuple[list, ...]:
            ids = [tool.encode(t, memo) for t in texts]
            if check and any(tool.decode(x) != (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)):
                raise ValueError("ids do not decode to their text")
            return ids if packed else [np.frombuffer(x, "<i4") for x in ids], [len(x) // 4 for x in ids]

        return run

    keep = [c for c in documents.columns if c not in ("ids", "n_tokens")]
    return map_rows(documents, keep, [F.col(text).cast("string")], [kind, ("n_tokens", "long", pa.int64())], make)


def decode(tokens: DataFrame, tokenizer: Codec) -> DataFrame:
    """Rows of ``tokens`` with ``decoded``, the bytes that ``ids`` stand for (null ids: no bytes).

    ids may be packed or array<int>, of any length. An id outside the vocabulary is an error. Every row
    comes back, repeated ones too; other columns stay, save ``decoded``, which is replaced; an empty
    table gives an empty table.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(tokenizer)
    packed = dict(tokens.dtypes)["ids"] == "binary"

    def make():
        tool = shared.value.ready()

        def run(ids: list) -> tuple[list, ...]:
            return ([tool.decode(b"" if x is None else x if packed else np.array(x, "<u4").tobytes()) for x in ids],)

        return run

    keep = [c for c in tokens.columns if c != "decoded"]
    return map_rows(tokens, keep, [F.col("ids")], [("decoded", "binary", pa.binary())], make)


def digests(documents: DataFrame, tokenizer: Codec) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they decode to.

    Null and empty texts have 0 tokens and the digests of no bytes; texts may be of any length. Every
    row comes back, repeated ones and null ids too; other columns are ignored; an empty table gives an
    empty table.
    """
    back = decode(encode(documents.select("doc_id", "text"), tokenizer, packed=True).drop("text"), tokenizer)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
