"""Vectors of a corpus as numbered shards: Parquet that is filled incrementally, or float16 shards that
a job which was stopped goes on with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from . import vector_format
from .commits import CommitLog, content
from .tables import identity

SCHEMA = "doc_id string, vector array<float>, shard int"


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], shard_rows: int = 100_000, batch: int = 64) -> DataFrame:
    """(doc_id, vector, shard) of ``texts(doc_id, text)``: vectors at length 1, texts of like length together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("text", key=lambda s: s.str.len(), ignore_index=True)
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                x = np.asarray(encoder(part["text"].tolist()), np.float32)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"doc_id": part["doc_id"], "vector": list(x / np.where(size > 0, size, 1))})

    made = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id string, vector array<float>")
    return made.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, texts.count() // shard_rows + 1))).cast("int"))


def fill(spark: SparkSession, path: str, texts: DataFrame, encoder: Callable, **options) -> None:
    """Encode what the store does not have yet and append it."""
    try:
        held = spark.read.schema(SCHEMA).parquet(path)
        texts = texts.join(held.select("doc_id"), "doc_id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    encode(texts, encoder, **options).write.mode("append").partitionBy("shard").parquet(path)


def check(vectors: DataFrame) -> DataFrame:
    """The table itself; gaps in shard numbers, repeated ids and mixed lengths are refused."""
    row = vectors.agg(F.max("shard").alias("last"), F.countDistinct("shard").alias("shards"), F.countDistinct("doc_id").alias("ids"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.size("vector")).alias("lengths")).first()
    if row["n"] and (row["last"] + 1 != row["shards"] or row["ids"] != row["n"] or row["lengths"] != 1):
        raise InputError(f"shards do not fit together: {row.asDict()}")
    return vectors


#: Characters that a batch of texts may have when all are padded to the longest.
BATCH_CHARS = 1 << 17
LAID = "doc_id string, text string, bucket int"


def packed(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices of texts, longest first, whose number times their longest length is ``most`` at the most;
    a longer text is alone."""
    a = 0
    while a < len(lengths):
        b = min(len(lengths), a + max(1, most // max(1, lengths[a])))
        yield a, b
        a = b


def encode_shards(spark: SparkSession, path: str, texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], name: str, shard_rows: int = 100_000, batch_chars: int = BATCH_CHARS, wave: int = 32) -> dict[str, list[int]]:
    """Encode ``texts(doc_id, text)`` into float16 shards below ``path``; what is there already is not done again.

    A text's shard follows from its id, so it is the same in every run. Texts are laid out by shard
    once; then ``wave`` shards at a time are encoded, written and committed to a log. A run that was
    stopped leaves finished waves and goes on with the others. Other texts, another encoder ``name``, or
    other sizes are refused, as they would mix vectors in one folder. Texts of like
    length share a batch, whatever their shard. A null text is empty; null and repeated ids are refused. The report lists the
    shards that were encoded now and before.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    facts = content(rows, "doc_id", "text").first()
    shards = max(1, -(-facts["rows"] // shard_rows))
    log = CommitLog(spark, f"{path}-commits")
    log.begin(encoder=name, texts=facts["digest"], shards=shards, batch_chars=batch_chars)
    laid = f"{path}-texts"
    done = log.done()
    if "texts" not in done:
        bad = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1").limit(1).collect()
        if bad:
            raise InputError(f"doc_id {bad[0].doc_id} is null or repeats")
        rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition(tasks, "bucket", F.pmod(F.hash("doc_id"), F.lit(-(-tasks // shards)))).write.mode("overwrite").partitionBy("bucket").parquet(laid)
        held = spark.read.schema(LAID).parquet(laid).groupBy("bucket").count().collect() if facts["rows"] else []
        log.commit({"texts": {"buckets": sorted((r.bucket, r["count"]) for r in held)}})  # shards are numbered without gaps
        done = log.done()
    vector_format.register(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in packed(pdf["text"].str.len().tolist(), batch_chars):
                part = pdf.iloc[a:b]
                x = np.asarray(encoder(part["text"].tolist()), np.float32)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"doc_id": part["doc_id"], "vector": list(x / np.where(size > 0, size, 1)), "shard": part["shard"], "length": part["text"].str.len()})

    buckets = done["texts"]["buckets"]
    todo = [s for s in range(len(buckets)) if f"shard {s}" not in done]
    for at in range(0, len(todo), wave):
        now = todo[at : at + wave]
        own = [buckets[s][0] for s in now]
        part = spark.read.schema(LAID).parquet(laid).where(F.col("bucket").isin(own))
        part = part.select("doc_id", "text", F.get(F.array(*map(F.lit, now)), (F.array_position(F.array(*map(F.lit, own)), F.col("bucket")) - 1).cast("int")).alias("shard"))
        # A shard is encoded by all tasks, longest texts first, and only its vectors come together to be written.
        dealt = part.repartition(tasks, "doc_id").sortWithinPartitions(F.desc(F.length("text")), "doc_id")
        made = dealt.mapInPandas(run, f"{vector_format.SCHEMA}, length int")
        whole = made.repartition(len(now), "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id").drop("length")
        whole.write.format(vector_format.FORMAT).mode("append").save(path)
        log.commit({f"shard {s}": {"rows": buckets[s][1]} for s in now})
    return {"encoded": todo, "held": sorted(set(range(len(buckets))) - set(todo))}


def checkpoint_label(name: str, revision: str, settings: dict) -> str:
    """Which weights and which settings of the index a dense run was made with."""
    import json

    # Fixed value: the format of the label.
    return f"{name}@{revision[:12]}|index:fp16-exact-{identity(json.dumps(settings, sort_keys=True))[:12]}"
