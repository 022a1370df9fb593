"""Shared plumbing of the training-data operators: the shared folder, cut lineage, batches, groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local session gets one of its own; a cluster has to name one, because a
    machine's own folder would be lost with the machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = LOCAL_DEFAULT
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tributary-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it below the shared folder and read it from there.

    Later stages then start from files that outlive any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 512, bytes_: int = 16 << 20) -> None:
    """Whole texts travel to Python in Arrow batches; few rows and bytes a batch keep workers small.

    Frames are lazy and read these settings when they run, so they stay in the session; they are only
    ever lowered. A row larger than ``bytes_`` is a batch of its own.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", bytes_)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal ``keys`` from sorted batches, each whole. Callers bound the size of a run."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if pdf.empty:
            continue
        key = pdf[keys]
        new = (key != key.shift()).any(axis=1).to_numpy()
        new[0] = last is None or tuple(key.iloc[0]) != last
        starts = [*new.nonzero()[0], len(pdf)]
        if not new[0]:
            starts = [0, *starts]
        for a, b in zip(starts, starts[1:], strict=False):
            if new[a] and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf.iloc[a:b])
        last = tuple(key.iloc[-1])
    if held:
        yield pd.concat(held, ignore_index=True)


def _values(column: pa.Array) -> list:
    """Python values; lists of numbers come as arrays, not as one object a number."""
    if pa.types.is_list(column.type) and pa.types.is_primitive(column.type.value_type) and not column.values.null_count:
        flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
        return [None if gone else flat[a:b] for a, b, gone in zip(at, at[1:], column.is_null().to_pylist(), strict=False)]
    return column.to_pylist()


def map_rows(
    df: DataFrame,
    keep: list[str],
    inputs: list[Column],
    added: list[tuple[str, str, pa.DataType]],
    make: Callable[[], Callable[..., tuple[list, ...]]],
) -> DataFrame:
    """Columns ``keep`` of ``df`` as they are, and columns that Python works out from ``inputs``.

    ``make`` runs once in a task and gives a function from one list per input to one list per added
    column (name, DDL type, Arrow type). Kept columns pass through in Arrow, so nulls and large
    numbers stay exact, and names of inputs cannot clash with them.
    """
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(f"__input_{i}") for i, c in enumerate(inputs)])
    fields = [chosen.schema[i] for i in range(len(keep))]
    schema = T.StructType([*fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in added)])
    names, n = [*keep, *(a[0] for a in added)], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            out = f(*(_values(b.column(i)) for i in range(n, b.num_columns)))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(o, a[2]) for o, a in zip(out, added, strict=True))], names=names)

    return chosen.mapInArrow(run, schema)


#: Rows of plain ids that may be broadcast.
MOST_IDS = 2_000_000


def bounded(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has at most MOST_IDS rows.

    With more rows it stays as it is and the join shuffles.
    """
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def shuffle_partitions(spark: SparkSession) -> int:
    """A number of partitions that stays, where Python takes far longer than the bytes suggest."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
