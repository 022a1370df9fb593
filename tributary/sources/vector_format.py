"""Numbered float16 shards of vectors as a Spark data source: ``format("vector_shards")``.

One partition of a read is one shard. Its vectors are streamed in blocks of rows, so a task holds a
block, not a shard. A write takes rows that have a shard number, writes each shard of a task to files of
its own and moves them into place when all tasks have ended, ids first: a shard exists once its vectors do.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import InputError

FORMAT, SCHEMA = "vector_shards", "doc_id string, vector array<float>, shard int"
# The names and the number type of the shard format.
IDS, VECTORS, META, DTYPE = "ids_{:05d}.txt", "emb_{:05d}.npy", "meta.json", "float16"
_VECTORS = re.compile(r"emb_(\d{5,})\.npy$")
#: Vectors that a reading task holds at once.
BLOCK = 4096


def _folder(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1))


def shard_numbers(path: str, whole: bool = True) -> list[int]:
    """Numbers of the shards at ``path``; with ``whole`` none and gaps are refused."""
    store, root = _folder(path)
    found = store.get_file_info(files.FileSelector(root, allow_not_found=True))
    numbers = sorted(int(m[1]) for f in found if (m := _VECTORS.search(f.base_name)))
    if whole and not numbers:
        raise InputError(f"no shards at {path}")
    if whole and (gaps := sorted(set(range(numbers[-1] + 1)) - set(numbers))):
        raise InputError(f"shards {gaps[:20]} are missing at {path}")
    return numbers


@dataclass
class _Shard(InputPartition):
    number: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Shard(n) for n in shard_numbers(self.path)]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        store, root = _folder(self.path)
        n = partition.number
        with store.open_input_stream(f"{root}/{IDS.format(n)}") as f:
            ids = f.read().decode().split("\n")[:-1]
        with store.open_input_stream(f"{root}/{VECTORS.format(n)}") as f:
            header = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[np.lib.format.read_magic(f)]
            shape, by_column, kind = header(f)
            if len(shape) != 2 or by_column or shape[0] != len(ids):
                raise InputError(f"shard {n}: {len(ids)} ids and vectors of shape {shape}")
            for a in range(0, shape[0], BLOCK):
                b = min(shape[0], a + BLOCK)
                rows = np.frombuffer(f.read((b - a) * shape[1] * kind.itemsize), kind).reshape(b - a, shape[1])
                offsets = pa.array(np.arange(0, rows.size + 1, shape[1], dtype=np.int32) if shape[1] else np.zeros(b - a + 1, np.int32))
                vectors = pa.ListArray.from_arrays(offsets, pa.array(rows.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), vectors, pa.array(np.full(b - a, n, np.int32))], names=["doc_id", "vector", "shard"])


@dataclass
class _Written(WriterCommitMessage):
    shards: list[tuple[int, str, int, int]]  # number, suffix of its files, rows, length of a vector


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _folder(self.path)
        store.create_dir(root, recursive=True)
        out, ids, rows, now = [], [], [], None

        def end() -> None:
            if now is None:
                return
            lengths = {len(v) for v in rows}
            if len(lengths) != 1:
                raise InputError(f"shard {now} has vectors of lengths {sorted(lengths)}")
            suffix = f".{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(f"{root}/{IDS.format(now)}{suffix}") as f:
                f.write("".join(f"{i}\n" for i in ids).encode())
            with store.open_output_stream(f"{root}/{VECTORS.format(now)}{suffix}") as f:
                np.lib.format.write_array(f, np.stack(rows).astype(DTYPE), allow_pickle=False)
            out.append((now, suffix, len(ids), lengths.pop()))

        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i, v, s in zip(named["doc_id"].to_pylist(), named["vector"].to_pylist(), named["shard"].to_pylist(), strict=True):
                if i is None or v is None or s is None or s < 0 or "\n" in i:
                    raise InputError(f"a row of shard {s} has no id of one line, no vector or no number")
                if s != now:
                    end()
                    ids, rows, now = [], [], s
                ids.append(i)
                rows.append(np.asarray(v, DTYPE))
        end()
        return _Written(out)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _folder(self.path)
        shards = sorted(x for m in messages if m is not None for x in m.shards)
        numbers = [s[0] for s in shards]
        lengths = {s[3] for s in shards}
        old = shard_numbers(self.path, whole=False)
        meta_path = f"{root}/{META}"
        meta = None
        if not self.overwrite and store.get_file_info(meta_path).type == files.FileType.File:
            with store.open_input_stream(meta_path) as f:
                meta = json.loads(f.read())
            lengths.add(meta["dim"])
        try:
            if len(set(numbers)) < len(numbers):
                raise InputError(f"shards {sorted({n for n in numbers if numbers.count(n) > 1})[:20]} come from several tasks; deal rows out by shard and sort them")
            if len(lengths) > 1:
                raise InputError(f"vectors of lengths {sorted(lengths)} in one folder")
        except InputError:
            self.abort(messages)
            raise
        for n, suffix, *_ in shards:
            store.move(f"{root}/{IDS.format(n)}{suffix}", f"{root}/{IDS.format(n)}")
            store.move(f"{root}/{VECTORS.format(n)}{suffix}", f"{root}/{VECTORS.format(n)}")
        if self.overwrite:
            for n in set(old) - set(numbers):
                store.delete_file(f"{root}/{VECTORS.format(n)}")
                store.delete_file(f"{root}/{IDS.format(n)}")
        if shards and meta is None:
            with store.open_output_stream(meta_path) as f:
                f.write(json.dumps({"dim": lengths.pop(), "dtype": DTYPE}, indent=2).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _folder(self.path)
        for n, suffix, *_ in (x for m in messages if m is not None for x in m.shards):
            for name in (IDS, VECTORS):
                store.delete_file(f"{root}/{name.format(n)}{suffix}")


class VectorShards(DataSource):
    """Options: ``path``, the folder of the shards."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorShards)
