"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled as good; web text without regard to labels is the unlabelled
side, a mixture of good and bad. The class prior, the share of good text in the mixture, is estimated
from how both sides spread over a first classifier's scores. The model then minimises the
non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with logistic loss, so its score estimates the chance that a document is good. Negative labels are
never used. Features are of form only: hashed trigrams of character classes and a few ratios, so
that no language, source or word list enters.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows, written

#: Rows of either side that the model is fitted on; beyond this a fixed hash order of doc_id decides.
SAMPLE = 6_000
BUCKETS = 1024
RATIOS = 8
DIMENSIONS = BUCKETS + RATIOS
_STEP = 1 << 20


def _classes() -> np.ndarray:
    """Byte -> class: lower, upper, digit, white space, other letters, and each ASCII sign its own."""
    table = np.full(256, 4, np.int64)
    for b in range(128):
        c = chr(b)
        table[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() or b < 32 else 5 + b
    return table


_CLASS = _classes().astype(np.uint8)


def features(text: str | None) -> np.ndarray:
    """Form of a text as float32; a null or empty text is all zeros."""
    out = np.zeros(DIMENSIONS, np.float32)
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    counts = np.zeros(BUCKETS, np.int64)
    kinds = np.zeros(256, np.int64)
    for s in range(0, len(data), _STEP):
        c = _CLASS[np.frombuffer(data[s : s + _STEP + 2], np.uint8)].astype(np.uint64)
        kinds += np.bincount(c[:_STEP].astype(np.uint8), minlength=256)
        code = (c[:-2] << np.uint64(16)) | (c[1:-1] << np.uint64(8)) | c[2:]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        counts += np.bincount((code % np.uint64(BUCKETS)).astype(np.int16), minlength=BUCKETS)
    n = len(data)
    out[:BUCKETS] = np.sqrt(counts / max(1, n - 2))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    w = max(1, len(words))
    out[BUCKETS:] = (
        np.log1p(n) / 10,
        np.log1p(w) / 10,
        kinds[1] / n,
        kinds[2] / n,
        kinds[5:].sum() / n,
        len(set(words)) / w,
        len(set(lines)) / max(1, len(lines)),
        min(3.0, sum(map(len, words)) / w / 10),
    )
    return out


class Model:
    """Standardised features, one layer of tanh units and a logistic output."""

    def __init__(self, parts: list[np.ndarray], shift: np.ndarray, scale: np.ndarray):
        self.parts, self.shift, self.scale = parts, shift, scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c, u = self.parts
        z = np.clip((x - self.shift) * self.scale, -8, 8)
        return np.tanh(z @ w + b) @ v + z @ u + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int, epochs: int, hidden: int = 16) -> Model:
    """Adam on the non-negative risk, or without a prior on plain positive-against-unlabelled loss."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    shift, spread = both.mean(axis=0), both.std(axis=0)
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0).astype(np.float32)
    d = both.shape[1]
    parts = [(rng.normal(0, 0.3 / np.sqrt(d), (d, hidden))).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, 0.1, hidden).astype(np.float32), np.zeros(1, np.float32), np.zeros(d, np.float32)]
    model = Model(parts, shift.astype(np.float32), scale)
    first, second, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    size = 256
    zp, zu = (np.clip((x - model.shift) * scale, -8, 8).astype(np.float32) for x in (pos, unl))
    steps = max(1, max(len(zp), len(zu)) // size)
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(max(len(zp), steps * size)) % len(zp), rng.permutation(max(len(zu), steps * size)) % len(zu)
        for k in range(steps):
            p, u = zp[order_p[k * size : (k + 1) * size]], zu[order_u[k * size : (k + 1) * size]]
            z = np.concatenate([p, u])
            w, b, v, c, direct = parts
            h = np.tanh(z @ w + b)
            g = h @ v + z @ direct + c[0]
            s = 1 / (1 + np.exp(-np.clip(g, -60, 60)))
            is_p = np.arange(len(z)) < len(p)
            if prior is None:
                slope = np.where(is_p, (s - 1) / len(p), s / len(u))
            else:
                # logistic loss: loss(+)' = s - 1, loss(-)' = s, loss(-) = -log(1 - s)
                minus = np.logaddexp(0, np.clip(g, -60, 60))
                negative = minus[~is_p].mean() - prior * minus[is_p].mean()
                rest = np.where(is_p, -prior * s / len(p), s / len(u))
                slope = -rest if negative < 0 else np.where(is_p, prior * (s - 1) / len(p), 0) + rest
            slope = slope.astype(np.float32)
            back = (slope[:, None] * v) * (1 - h * h)
            grads = [z.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()], np.float32), z.T @ slope]
            t += 1
            rate = 2e-3 * (1 - 0.9 * epoch / max(1, epochs))
            for i, (q, dq) in enumerate(zip(parts, grads, strict=True)):
                dq = dq + (2e-4 * q if i in (0, 2, 4) else 0)
                first[i] = 0.9 * first[i] + 0.1 * dq
                second[i] = 0.999 * second[i] + 0.001 * dq * dq
                q -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return model


def estimate_prior(pos: np.ndarray, unl: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled, from the scores of both: the best-bin bound.

    Above any threshold the unlabelled share is at least prior times the positive share; the ratio
    is least where nearly only positives are left. A bound on the deviation of both shares keeps the
    choice away from thresholds that few positives reach.
    """
    at = np.sort(np.unique(pos))
    qp = 1 - np.searchsorted(np.sort(pos), at, "left") / len(pos)
    qu = 1 - np.searchsorted(np.sort(unl), at, "left") / len(unl)
    slack = np.sqrt(np.log(4 / confidence) / 2 / len(pos)) + np.sqrt(np.log(4 / confidence) / 2 / len(unl))
    bound = (qu + slack) / np.maximum(qp, 1e-9)
    k = int(np.argmin(bound))
    return float(np.clip(qu[k] / qp[k], 0.02, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, seed: int = 7, epochs: int = 30) -> tuple[Model, float]:
    """Model and class prior from positive and unlabelled features."""
    half = np.random.default_rng(seed).random(len(pos)) < 0.5
    halfu = np.random.default_rng(seed + 1).random(len(unl)) < 0.5
    if len(pos) < 20 or len(unl) < 20 or not (0 < half.sum() < len(pos)) or not (0 < halfu.sum() < len(unl)):
        prior = 0.5
    else:
        first = _fit(pos[half], unl[halfu], None, seed, max(3, epochs // 6))
        prior = estimate_prior(first.raw(pos[~half]), first.raw(unl[~halfu]))
    return _fit(pos, unl, prior, seed, epochs), prior


def held_out(doc_id):
    """One row in five, by the checksum of its id, is kept from training."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _sampled(ids: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` ids in the order of their hash: the same ids at any partitioning."""
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model | None, float]:
    """Model and class prior from the rows that are not held out.

    Positives are documents labelled 1, the unlabelled side is drawn from all documents; either
    side has at most ``sample`` rows, which one task fits on, and the driver receives the weights.
    Labels are used only to find positives; null, repeated and unmatched ones do no harm. Fewer than
    20 rows on either side give no model. Texts may be of any length: they are read in pieces.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    good = labels.where("quality = 1").select("doc_id").join(rows.select("doc_id"), "doc_id", "left_semi")
    chosen = [_sampled(d, sample).withColumn("positive", F.lit(p)) for d, p in ((good, True), (rows.select("doc_id"), False))]
    ids = written(chosen[0].unionByName(chosen[1]), "training-ids")
    texts = rows.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "positive"])
    added = [("x", "binary", pa.binary())]
    got = map_rows(texts, ["positive"], [F.col("text").cast("string")], added, lambda: lambda ts: ([features(t).astype(np.float16).tobytes() for t in ts],))
    sample_of = written(got, "training-features")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for batch in batches:
            for positive, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sides[positive].append(np.frombuffer(x, np.float16))
        if min(map(len, sides.values())) >= 20:
            pos, unl = (np.stack(sides.pop(p)).astype(np.float32) for p in (True, False))
            order = [np.lexsort(x.T[:8]) for x in (pos, unl)]  # the same order at any partitioning
            model, prior = fit(pos[order[0]], unl[order[1]])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary()), pa.array([prior])], names=["model", "prior"])

    # One task fits on the bounded sample; the driver sees the weights only.
    rows = sample_of.select("positive", "x").coalesce(1).mapInArrow(fitted, "model binary, prior double").collect()
    return (pickle.loads(rows[0].model), rows[0].prior) if rows else (None, 0.5)


def scores(documents: DataFrame, model: Model | None, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` and the score of every row's whole text; without a model each score is 0.5."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> tuple[list, ...]:
        if shared.value is None:
            return ([0.5] * len(texts),)
        return ([float(s) for s in shared.value.score(np.stack([features(t) for t in texts]))] if texts else [],)

    return map_rows(documents, keep, [F.col("text").cast("string")], [(name, "double", pa.float64())], lambda: run)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) for every row of ``documents``.

    Every row comes back, repeated ones too; a null doc_id counts as not held out; null and empty
    texts get the score of a text without features. Other columns are ignored, clashing names too.
    An empty table gives an empty table.
    """
    model, _ = train(documents, labels, sample)
    scored = scores(documents.select("doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
