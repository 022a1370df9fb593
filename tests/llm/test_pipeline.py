import corpus_pipeline as C
import pytest

import __spark_entry__ as entry
from tests.llm.conftest import frame
from tributary.llm.common import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in C.STAGES:
        before, docs = docs, written(stage(spark, docs, FOLDER), "stage")
        out.append((before, docs))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_take_effect_and_keep_columns(spark, stages):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    for before, after in stages[:-1]:
        assert after.columns == C.COLUMNS and ids(after) <= ids(before)
    assert len(ids(stages[0][1])) < len(ids(stages[0][0])) and ids(stages[4][1]) == ids(stages[4][0])


def test_stages_agree_with_their_operators(spark, stages):
    from tests.llm import test_line_dedup, test_near_dedup

    before, after = stages[1]
    want = dict(test_line_dedup.brute([(r.doc_id, r.text) for r in before.collect()]))
    assert {r.doc_id: r.text for r in after.collect()} == {d: t for d, t in want.items() if t and t.strip(" ")}
    before, after = stages[2]
    rows, _ = test_near_dedup.brute([(r.doc_id, r.text) for r in before.collect()], C.SIMILARITY)
    assert ids(after) == {c for _, _, c in rows}
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    from tests.llm import test_decontaminate

    assert ids(before) - ids(after) == {d for d, _ in test_decontaminate.brute([(r.doc_id, r.text) for r in before.collect()], items)}


def test_run_is_registered(spark, stages):
    assert {r.doc_id: r.n_tokens for r in entry.queries()["pipeline"](spark, FOLDER).collect()} == {r.doc_id: r.n_tokens for r in stages[-1][1].collect()}


def test_stages_take_edges(spark, edge, nothing):
    labels = FOLDER
    for docs in (edge.select(*C.COLUMNS), frame(spark, []).select(*C.COLUMNS)):
        for _, stage in C.STAGES:
            docs = written(stage(spark, docs, labels), "edge")
        assert "n_tokens" in docs.columns
