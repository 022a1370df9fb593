"""One query per training-data operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, filter_audit, lexical_search, line_dedup, near_dedup, neighbours, oracles, quality, quality_rules, secrets, substring_dedup, token_rollups, warc

#: The vocabulary of op10; the files belong to the installed tokenizers, not to this repository.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The tokenizers of op2, old version first.
TOKENIZER_VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark question, as it is or with other names and numbers."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents by source, language and tokenizer version, kept by deltas."""
    old, new = ((v, public_tokenizers.path(f"{v}.tiktoken")) for v in TOKENIZER_VERSIONS)
    return token_rollups.history(_table(spark, sf_dir, "documents"), old, new, public_tokenizers.PATTERN)


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of the whole text of every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=1000)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the whole text of every document and in the layers decoded from it."""
    return secrets.span_digests(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the line blocks that an earlier document has."""
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op8_bwt_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that begin earlier as well."""
    return substring_dedup.digests(_table(spark, sf_dir, "documents"), length=100)


def op9_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product found for every twentieth vector."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes that they decode to, as digests."""
    tokenizer = bpe.codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest lexical score for every benchmark item."""
    return lexical_search.top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove of every source, in each of their 120 orders."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every document, and whether it is kept; its source is its host."""
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_token_rollups": op2_token_rollups,
    "op3_pu_quality": op3_pu_quality,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_secret_scan": op5_secret_scan,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_bwt_substring_dedup": op8_bwt_substring_dedup,
    "op9_projected_neighbours": op9_projected_neighbours,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality_rules": op13_quality_rules,
    "pipeline": corpus_pipeline.run,
}
#: The others have models, decoded layers, alignments, token merges or an index in them; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_warc_round_trip": oracles.OP4,
    "op6_minhash_near_dedup": oracles.OP6,
    "op8_bwt_substring_dedup": oracles.OP8,
    "op11_lexical_search": oracles.OP11,
    "op12_filter_audit": oracles.OP12,
    "op13_quality_rules": oracles.OP13,
}
