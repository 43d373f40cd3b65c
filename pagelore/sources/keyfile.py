"""Binary key files as a Spark data source.

``spark.dataSource.register(KeyFile)``, then ``spark.read.format("keyfile").options(...).load(path)``. Options:
kind keys (query_idx, key), ranges (query_idx, lo, hi) or values; dtype uint64, int64, uint32, uint8 or
float64; header auto (an 8-byte count that equals what follows it), yes or no; count, the number of items that
must be there; limit, the first items in file order; fix_sentinel; split, bytes per partition. Unsigned keys of
2^63 and more don't fit a bigint: they fail, unless ``flip_sign`` maps all keys by an order-keeping shift of
2^63. A directory is read as its part files in name order. Paths are opened by Arrow's file systems, so URIs of
shared stores do. Files are read by byte range, one partition each; nothing is read whole.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SENTINEL = (1 << 64) - 1
TYPES = {"uint64": "<u8", "int64": "<i8", "uint32": "<u4", "uint8": "u1", "float64": "<f8"}


def resolve_path(path: str, folder: str | None = None) -> str:
    """Absolute paths and URIs as they are (a file URI as its path), existing ones made absolute, others in
    DATASETS_DIRECTORY or folder."""
    if path.startswith("file:"):
        return re.sub("^file:/*", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) or os.path.isabs(path):
        return path
    if os.path.exists(path):
        return os.path.abspath(path)
    return os.path.join(os.environ.get("DATASETS_DIRECTORY") or folder or "datasets", path)


def _open(path: str):
    return (pafs.LocalFileSystem(), path) if os.path.isabs(path) else pafs.FileSystem.from_uri(path)


def parts_of(path: str) -> list[tuple[str, int]]:
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    return sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")))


def detect_layout(path: str, width: int, header: str = "auto", count: int | None = None) -> tuple[int, int]:
    """(bytes to skip, items). auto: an 8-byte head is a count if it says exactly how many items follow."""
    parts = parts_of(path)
    size = sum(n for _, n in parts)
    has = header == "yes"
    if header == "auto" and parts and parts[0][1] >= 8 and (size - 8) % width == 0:
        fs, _ = _open(path)
        with fs.open_input_file(parts[0][0]) as f:
            head = int.from_bytes(f.read(8), "little")
        has = head == (size - 8) // width and (count is None or count == head)
    skip = 8 if has else 0
    if (size - skip) % width:
        raise ValueError(f"{path}: {size - skip} bytes are no whole number of {width}-byte items")
    items = (size - skip) // width
    if count is not None and count != items:
        raise ValueError(f"{path}: {items} items, {count} expected")
    return skip, items


@dataclass
class Slice(InputPartition):
    file: str
    start: int
    items: int
    first: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = resolve_path(options["path"])
        self.kind, self.dtype = options.get("kind", "keys"), options.get("dtype", "uint64")
        self.header, self.split = options.get("header", "auto"), int(options.get("split", 32 << 20))
        self.count = int(options["count"]) if "count" in options else None
        self.limit = int(options["limit"]) if "limit" in options else None
        self.fix, self.flip = (str(options.get(k, "false")).lower() == "true" for k in ("fix_sentinel", "flip_sign"))
        self.width = np.dtype(TYPES[self.dtype]).itemsize * (2 if self.kind == "ranges" else 1)

    def partitions(self):
        skip, items = detect_layout(self.path, self.width, self.header, self.count)
        left, first, out = min(items, self.limit) if self.limit is not None else items, 0, []
        step = max(1, self.split // self.width)
        for file, size in parts_of(self.path):
            at, here = skip, (size - skip) // self.width
            skip = 0
            while here > 0 and left > 0:
                n = min(step, here, left)
                out.append(Slice(file, at, n, first))
                at, here, left, first = at + n * self.width, here - n, left - n, first + n
        return out or [Slice("", 0, 0, 0)]

    def read(self, s: Slice):
        fs, _ = _open(self.path)
        step = max(1, (4 << 20) // self.width)
        for k in range(0, s.items, step):
            n = min(step, s.items - k)
            with fs.open_input_file(s.file) as f:
                f.seek(s.start + k * self.width)
                x = np.frombuffer(f.read(n * self.width), TYPES[self.dtype])
            yield self._batch(x, s.first + k)

    def _values(self, x):
        if self.dtype == "float64":
            return pa.array(x)
        if self.dtype == "uint64":
            if self.fix:
                x = np.where(x == SENTINEL, np.uint64(SENTINEL - 1), x)
            if self.flip:
                x = x ^ np.uint64(1 << 63)
            elif len(x) and x.max() >= 1 << 63:
                raise ValueError("keys of 2^63 and more need flip_sign")
            x = x.view(np.int64) if x.flags.c_contiguous else np.ascontiguousarray(x).view(np.int64)
        return pa.array(x.astype(np.int64))

    def _batch(self, x, first):
        if self.kind == "ranges":
            lo, hi = x[0::2], x[1::2]
            idx = np.arange(first, first + len(lo))
            if self.fix:  # ranges that touch the reserved key go
                ok = (lo != SENTINEL) & (hi != SENTINEL)
                lo, hi, idx = np.minimum(lo, hi)[ok], np.maximum(lo, hi)[ok], idx[ok]
            return pa.record_batch([pa.array(idx), self._values(lo), self._values(hi)], names=["query_idx", "lo", "hi"])
        return pa.record_batch([pa.array(np.arange(first, first + len(x))), self._values(x)], names=["query_idx", "key"])


@dataclass
class Written(WriterCommitMessage):
    file: str
    items: int


class Writer(DataSourceWriter):
    """One part file for each partition, in partition order, so that a range-partitioned relation is sorted on
    disk. header yes: the count goes to a first file of its own. A failed write leaves no part file."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind = resolve_path(options["path"]), options.get("kind", "keys")
        self.dtype, self.header = options.get("dtype", "uint64"), options.get("header", "no")
        fs, at = _open(self.path)
        if overwrite and fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir_contents(at)
        fs.create_dir(at, recursive=True)

    def write(self, rows):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, at = _open(self.path)
        name, n = f"{at}/_part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}", 0
        with fs.open_output_stream(name) as f:
            for r in rows:
                v = (r["lo"], r["hi"]) if self.kind == "ranges" else (r["key"],)
                f.write(np.array(v, np.int64 if self.dtype != "float64" else np.float64).astype(TYPES[self.dtype]).tobytes())
                n += 1
        return Written(name, n)

    def commit(self, messages):
        fs, at = _open(self.path)
        for m in messages:
            folder, name = m.file.rsplit("/", 1)
            fs.move(m.file, f"{folder}/{name[1:].rsplit('-', 1)[0]}.bin")
        if self.header == "yes":
            with fs.open_output_stream(f"{at}/count.bin") as f:
                f.write(sum(m.items for m in messages).to_bytes(8, "little"))

    def abort(self, messages):
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.file)


class KeyFile(DataSource):
    @classmethod
    def name(cls):
        return "keyfile"

    def schema(self):
        value = "double" if self.options.get("dtype") == "float64" else "bigint"
        return f"query_idx bigint, lo {value}, hi {value}" if self.options.get("kind") == "ranges" else f"query_idx bigint, key {value}"

    def reader(self, schema):
        return Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(KeyFile)


def load_partitions(spark, par_path: str, bitmap_path: str):
    """(part_id, len, is_range) from a file of lengths and one of flags; they must be of one size."""
    from pyspark.sql import functions as F

    register(spark)
    a = spark.read.format("keyfile").option("dtype", "uint64").option("header", "no").load(par_path)
    b = spark.read.format("keyfile").option("dtype", "uint8").option("header", "no").load(bitmap_path)
    n, m = a.count(), b.count()
    bad = a.where("key <= 0").count() + b.where("key not in (0, 1)").count()
    if n != m or bad:
        raise ValueError(f"{n} lengths, {m} flags, {bad} bad values")
    return a.join(b.withColumnRenamed("key", "is_range"), "query_idx").select(F.col("query_idx").alias("part_id"), F.col("key").alias("len"), F.col("is_range").cast("tinyint").alias("is_range"))
