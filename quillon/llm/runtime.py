"""Shared folder, shipped code and small reductions that the operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def release() -> None:
    """Give memory that the driver has freed (after a fit) back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle and checkpoint files of finished steps: its cleaner acts when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


WORD_BREAK = r"[\x20\x09-\x0D]+"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application; Spark's own file server deals it out."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # whole texts: smaller batches bound a worker's memory
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{16 << 20}")  # the same for rows of megabytes; a longer row is a batch


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if not current.isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder; lost executors don't force a recomputation of what is above."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that are deleted when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, group_rows: int | None = None, by: str | None = None, codec: str = "zstd") -> DataFrame:
        """by: an integer column of few values, each written in a folder of its own.
        group_rows bounds the rows of a row group, for tables whose rows are megabytes: readers hold a row group at a time.

        Tables take zstd, which works in small buffers; Snappy's are as large as a page and lie outside the heap until they are collected.
        """
        self.n += 1
        path = f"{self.base}/{self.n}"
        writer = df.write.option("compression", codec)
        if group_rows:
            writer = writer.option("parquet.block.row.count.limit", group_rows)
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_array(text):
    """Column of the words of a text column; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def crc_mod(doc_id, m: int):
    """crc32 of the id as text, modulo m; null for a null id."""
    return (F.crc32(doc_id.cast("string")) % m).cast("int")


SLICE = 1 << 14
FAN = 64
ARRAY_SCHEMA = "part int, task int, cells binary"


def array_rows(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's array as rows of (slice number, task, bytes), without slices that are all zero."""
    flat, task = np.ascontiguousarray(values).ravel(), TaskContext.get().partitionId()
    parts = [k for k in range(-(-len(flat) // SLICE)) if flat[k * SLICE : (k + 1) * SLICE].any()]
    for a in range(0, len(parts), 64):
        some = parts[a : a + 64]
        cells = [flat[k * SLICE : (k + 1) * SLICE].tobytes() for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([task] * len(some), pa.int32()), pa.array(cells, pa.binary())], ["part", "task", "cells"])


def sum_arrays(df: DataFrame, dtype: str, size: int, tasks: int) -> np.ndarray:
    """Sum of the arrays of `dtype` that so many tasks emitted, in doubles or 64-bit integers; the latter come back as unsigned
    32-bit numbers, where a full one stays full. Slices are summed on the executors by a tree, at most FAN of them in a group, and the
    driver gets one array of the given size."""
    wide = "int64" if np.dtype(dtype).kind in "iu" else "float64"

    def add(kind: str, last: bool):
        def run(table: pa.Table) -> pa.Table:
            total = None
            for chunk in table["cells"].chunks:
                for x in chunk:
                    one = np.frombuffer(x.as_buffer(), dtype=kind)
                    total = one.astype(wide) if total is None else np.add(total, one, out=total)
            if last and wide == "int64":
                total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
            return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "task": pa.array([table["task"][0].as_py()], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

        return run

    kind, last = dtype, False
    while not last:
        tasks = -(-tasks // FAN)
        last = tasks <= 1
        df = df.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("part", "task").applyInArrow(add(kind, last), ARRAY_SCHEMA)
        kind = wide
    out = np.zeros(size, dtype="uint32" if wide == "int64" else wide)
    for row in df.select("part", "cells").collect():
        piece = np.frombuffer(row["cells"], dtype=out.dtype)
        out[row["part"] * SLICE : row["part"] * SLICE + len(piece)] = piece
    return out


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Mark for broadcast only when its checked size allows; otherwise a shuffle join follows."""
    return F.broadcast(df) if small(df, rows) else df
