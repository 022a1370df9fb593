import zlib

import numpy as np
import pytest

from tests.llm.conftest import frame
from tributary.llm import quality, queries

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op3_pu_quality(spark, FOLDER).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(got) == 1000
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    own = [(r.predicted, truth[d]) for d, r in got.items() if r.held_out and d in truth]
    good = [p for p, t in own if t]
    assert np.mean([p == t for p, t in own]) > 0.93 and np.mean(good) > 0.97


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = ({r.doc_id: r.score for r in quality.classify(docs.limit(400), x).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b)


def test_edges(spark, edge, edge_rows, nothing):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = quality.classify(edge, labels)
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(edge_rows)
    assert all(r.score == 0.5 for r in rows)  # too few rows for a model
    model, prior = quality.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels.unionByName(labels))
    assert 0.5 < prior < 0.98
    scored = quality.scores(edge, model, ["doc_id", "text"]).collect()
    assert len({r.score for r in scored if not r.text}) == 1 and all(0 <= r.score <= 1 for r in scored)
    assert quality.classify(nothing, labels.limit(0)).count() == 0


def test_prior_and_risk_on_known_mixtures():
    rng = np.random.default_rng(0)
    pos = rng.normal(1.5, 1, (3000, 4)).astype(np.float32)
    for prior in (0.3, 0.7):
        is_pos = rng.random(4000) < prior
        unl = np.where(is_pos[:, None], rng.normal(1.5, 1, (4000, 4)), rng.normal(-1.5, 1, (4000, 4))).astype(np.float32)
        model, found = quality.fit(pos, unl)
        assert found == pytest.approx(prior, abs=0.06)
        assert np.mean((model.score(unl) >= 0.5) == is_pos) > 0.97


def test_features_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = "Some words, 12 numbers! " * 500
    whole = quality.features(text)
    monkeypatch.setattr(quality, "_STEP", 97)
    assert np.allclose(quality.features(text), whole)
    assert not quality.features(None).any() and not quality.features("").any()


def test_sampling_is_bounded(spark):
    ids = spark.range(500).selectExpr("id as doc_id")
    assert quality._sampled(ids.union(ids), 50).count() == 50
    assert frame(spark, []).count() == 0
