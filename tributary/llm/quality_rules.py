"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Every text is measured by itself, then its lines are normalised (white space, digits, case) and
hashed. A line that more than MOST_DOCS documents of one host hold is common there: it stays in the
first of them and is removed from the others. Documents that lose too much this way are depleted and
rejected, as are those that fail the base rules.

Texts are read once. What stays of a document is one row of counts and line hashes; only these are
exploded, counted by (host, line) and joined, so a host that holds a third of all documents is spread
over its lines, and a common line meets its holders in a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

GAP, SYMBOLS = r"[\x20\x09-\x0D]+", "[^#*$%&|<>]+"
#: Words of a window, words that a text needs, percent of words that repeated windows may cover.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Documents of a host that may hold a line, and percent of a document's words that must be left.
MOST_DOCS, LEAST_LEFT = 10, 50


def repeated_words(windows: Column) -> Column:
    """Places that windows cover which occur more than once; ``windows`` has one hash per place."""
    places = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(sorted_: Column) -> Column:
        def same(x, i):
            return F.coalesce(F.get(sorted_, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_, i + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(sorted_, same), lambda x: x["i"]))

    # Bound once: a lambda's variable is evaluated a single time.
    found = F.get(F.transform(F.array(places), again), F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(found, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p + WINDOW - s["end"])).alias("n"), (p + WINDOW).alias("end")))["n"]


def measured(documents: DataFrame, host: str = "source") -> DataFrame:
    """A row of measures and of (hash, words) of the normalised lines per row of ``documents``.

    ``row`` numbers the rows; it is written with them, so it stays what it is.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = F.lower(F.regexp_replace(F.regexp_replace("text", r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]+", "0"))
    cut = rows.select(
        "doc_id",
        "host",
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.array_remove(F.split("text", GAP, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.filter(F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x)), lambda x: x != "").alias("plain"),
    )
    n = F.size("words")
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<long>"))
    seen = cut.select(
        "doc_id", "host", "word_chars", "n_symbols", n.cast("long").alias("n_words"), windows.alias("windows"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("plain", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))).alias("lines"),
    )
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), repeated_words(F.col("windows"))).otherwise(0)
    counted = seen.select(F.monotonically_increasing_id().alias("row"), "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"), "lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return written(counted.withColumn("base_failed", failed), "measured")


def common_lines(rows: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, h, first, docs) of lines that more than ``most_docs`` documents of a host hold."""
    lines = rows.where("doc_id is not null").select("doc_id", "host", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    held = lines.groupBy("host", "h").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first"))
    return written(held.where(F.col("docs") > most_docs), "common-lines")


def apply_rules(documents: DataFrame, host: str = "source", most_docs: int = MOST_DOCS, least_left: int = LEAST_LEFT) -> DataFrame:
    """Measures and verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_words_lost.

    A document is kept if it passes the base rules and, without the lines that are common at its host, has
    LEAST_WORDS words and ``least_left`` percent of its words. The document of least doc_id keeps a
    common line, so of many copies one is whole. A null text is an empty one and fails, as does a text of
    white space; texts may be of any length. A null host is a host with an empty name. A null doc_id
    counts nowhere, but its row is judged after all others. Rows that repeat a doc_id count once and are
    judged alike. Columns other than doc_id, text and the host are ignored. An empty table gives an empty
    table.
    """
    rows = measured(documents, host)
    common = bounded(common_lines(rows, most_docs))
    lines = rows.where("not base_failed").select("row", "doc_id", "host", F.explode("lines").alias("l")).select("row", "doc_id", "host", "l.h", F.col("l.n").alias("words"))
    lost = lines.join(common, ["host", "h"]).where("doc_id is null or doc_id > first").groupBy("row").agg(F.sum("words").alias("n_words_lost"))
    judged = rows.drop("lines").join(bounded(written(lost, "lost-words")), "row", "left").withColumn("n_words_lost", F.coalesce("n_words_lost", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_words_lost")
    kept = ~F.col("base_failed") & (left >= LEAST_WORDS) & (100 * left >= least_left * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_words_lost")
