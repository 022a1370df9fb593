"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. In every stage extra columns are dropped, whatever their names; repeated rows are treated
alike and all that are kept come back; texts may be of any length; an empty table, and empty tables of
labels or benchmark items, give what is left of the input. ``run`` writes every stage's result below the shared folder and reads it back, so a
lost executor costs no more than the tasks of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from tributary.llm.common import bounded, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its quality score is lower; near copies are those of this similarity in percent.
QUALITY, SIMILARITY = 0.3, 80
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches QUALITY; the labels of the corpus train the model.

    Null and empty texts are scored as texts without features; a null doc_id trains nothing but is
    scored. Labels with nulls are not used. Without a model (fewer than 20 labelled rows) each score is
    0.5 and all documents stay. Ties at QUALITY stay.
    """
    model, _ = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.scores(docs.select(*COLUMNS), model, COLUMNS, name="__score")
    return scored.where(F.col("__score") >= QUALITY).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line blocks of earlier documents; those that nothing is left of go.

    Null and empty texts and rows with a null doc_id stay as they are. Of equal texts that of the least
    doc_id stays, with all its repeated rows; n_chars is counted anew where lines went.
    """
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", changed).select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies.

    Null, empty and blank texts and rows with a null doc_id are near nothing and stay. Rows that repeat
    a doc_id go or stay together.
    """
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=SIMILARITY)
    copies = bounded(written(found.where(~F.col("kept")).select("doc_id").distinct(), "copies"))
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question.

    Null and empty texts and rows with a null doc_id stay; items with nulls match nothing; without
    items all documents stay.
    """
    return decontaminate.clean(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, decoded again and compared with the text they came from.

    A null or empty text has no ids; every row comes back, with a null doc_id too.
    """
    tokenizer = bpe.codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    coded = bpe.encode(docs.select(*COLUMNS), tokenizer, check=True)
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_bpe),
]

#: Model fits, signatures and token merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
