"""Token counts as delta-maintained rollups.

Changes are signed: an insert adds a document and its tokens, a delete takes both away, a revised
count takes the old number away and adds the new one. A batch of changes is summed by source,
language and tokenizer version and committed as one partition of a table of deltas; totals are the
sums over all partitions. Committing a batch again replaces its own partition, so a retry or a
replay changes nothing, and no committed batch is ever rewritten by another.
"""

from __future__ import annotations

import pyarrow as pa
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import bounded_batches, map_rows, scratch, written

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, batch string"


def inserts(rows: DataFrame, tokens: Column) -> DataFrame:
    """Signed rows that add the documents of ``rows`` with their ``tokens``."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


def deletes(rows: DataFrame, tokens: Column) -> DataFrame:
    """Signed rows for documents that go: one less each, and their tokens. Rows that repeat go as often;
    a null count takes a document and no tokens, null keys are a group of their own."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-tokens).cast("long").alias("tokens"))


def revisions(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """Signed rows for documents whose count changes; the number of documents stays."""
    return rows.where(old != new).select(*KEYS, F.lit(0).cast("long").alias("docs"), (new - old).cast("long").alias("tokens"))


class Rollup:
    """Totals by source, language and tokenizer version below one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or scratch(spark, "rollup")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Add a batch of signed rows. The batch id stands for its content: again is as good as once.

        The changes are summed map-side before they are shuffled, so a hot source or language costs
        no more than another. An empty batch leaves no partition, and no trace of one committed
        before under its id.
        """
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        rows = written(sums.withColumn("batch", F.lit(batch)), "delta")
        if rows.limit(1).count() == 0 and batch in self.batches():
            rows = self.spark.createDataFrame([(None, None, None, 0, 0, batch)], DELTAS)
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.folder)

    def deltas(self) -> DataFrame:
        """All committed signed sums; before the first commit there are none. Reading changes nothing."""
        try:
            return self.spark.read.schema(DELTAS).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], DELTAS)

    def batches(self) -> list[str]:
        return [r.batch for r in self.deltas().select("batch").distinct().collect()]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; groups that came to nothing are left out."""
        sums = self.deltas().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0").select(*KEYS, "docs", "tokens")


def without_repeated_lines(text: str) -> str:
    return "\n".join(dict.fromkeys(text.split("\n")))


def counts(documents: DataFrame, old: tuple[str, str], new: tuple[str, str], pattern: str) -> DataFrame:
    """doc_id, source, lang, key and three token counts of every row.

    ``old`` and ``new`` are (version, rank file): n_old counts the text with the old tokenizer,
    n_revised the text without its repeated lines, n_new the latter with the new one. key is the
    digest of the text; null texts count as empty ones.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast({v: read_ranks(p) for v, p in (old, new)})

    def make():
        tools = {v: tiktoken.Encoding(v, pat_str=pattern, mergeable_ranks=dict(r), special_tokens={}) for v, r in shared.value.items()}
        first, second = tools[old[0]].encode_ordinary, tools[new[0]].encode_ordinary

        def run(texts: list[str | None]) -> tuple[list, ...]:
            out: tuple[list, ...] = ([], [], [])
            for t in texts:
                t = t or ""
                short = without_repeated_lines(t)
                out[0].append(len(first(t)))
                out[1].append(out[0][-1] if short == t else len(first(short)))
                out[2].append(len(second(short)))
            return out

        return run

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    added = [(n, "long", pa.int64()) for n in ("n_old", "n_revised", "n_new")]
    return map_rows(rows, ["doc_id", "source", "lang", "key"], [F.col("text")], added, make)


def history(documents: DataFrame, old: tuple[str, str], new: tuple[str, str], pattern: str, folder: str | None = None) -> DataFrame:
    """Totals after a corpus' life in four batches, two of them committed twice.

    All documents come in under the old tokenizer; later copies of a text (all but its least doc_id)
    are deleted; texts lose their repeated lines and are counted anew; what is left is counted under
    the new tokenizer's version as well. Null ids are never later copies; null sources and languages
    are groups of their own; rows that repeat the least id all stay; other columns are ignored; an
    empty table gives an empty table.
    """
    spark = documents.sparkSession
    each = written(counts(documents, old, new, pattern), "token-counts")
    least = each.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("key", "least")
    least = written(least, "copied-texts")  # a hot text can be split in a join of two exchanges
    marked = written(each.join(least, "key", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))), "marked")
    at = {v: marked.withColumn("tokenizer", F.lit(v)) for v in (old[0], new[0])}
    left = {v: df.where(~F.col("copy")) for v, df in at.items()}
    book = Rollup(spark, folder)
    batches = {
        "1-insert": inserts(at[old[0]], F.col("n_old")),
        "2-delete-copies": deletes(at[old[0]].where("copy"), F.col("n_old")),
        "3-revise": revisions(left[old[0]], F.col("n_old"), F.col("n_revised")),
        "4-new-tokenizer": inserts(left[new[0]], F.col("n_new")),
    }
    for batch in [*batches, "2-delete-copies", "3-revise"]:
        book.commit(batch, batches[batch])
    return book.totals()
