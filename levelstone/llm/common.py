"""Shared plumbing of the corpus operators: scratch tables, code shipping, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordhash import POWERS

_SHIPPED: set[str] = set()
#: Rows and bytes in one Arrow batch; a row larger than that is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers and bound the Arrow batches they get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(name)
    atexit.register(Path(name).unlink, missing_ok=True)  # the driver serves it as long as it lives
    _SHIPPED.add(sc.applicationId)


def released(run):
    """``run`` for mapInArrow, after which a worker that stays for later tasks gives its free memory back."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            POWERS.clear()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names. A cluster without one is an error; a session in one process, whose only
    machine is the driver's, gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Written tables that cut lineage; they survive lost executors and can be dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            if path := getattr(t, "scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    if column.null_count:
        empty = pa.scalar("" if "string" in str(column.type) else b"", type=column.type)
        column = column.fill_null(empty)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(off[0]), int(off[-1])) if len(off) else (0, 0)
    return raw[lo:hi], off - lo


def blocks(off: np.ndarray, limit: int = 1 << 19):
    """Ranges (i, j) of documents whose texts together take about ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_of(df: DataFrame, text: str = "text"):
    return F.coalesce(df[text].cast("string"), F.lit(""))
