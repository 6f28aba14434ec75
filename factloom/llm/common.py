"""Helpers the operators share: written tables in the shared folder, stable keys, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_roots: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can read and write: ``spark.checkpoint.dir``.

    Only a single-JVM session (``local[n]``) that leaves the setting out gets a folder of its own; on a cluster a
    missing setting is an error, because a machine-local folder would lose files there.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


class Scratch:
    """Tables written under one folder of the shared directory; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _roots.append(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back, with its path in ``table_path``."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}_{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.table_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.table_path)
            path.getFileSystem(conf).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every intermediate table of this process. Results that still read them must be written first."""
    conf = spark._jsc.hadoopConfiguration()
    while _roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(_roots.pop())
        path.getFileSystem(conf).delete(path, True)


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the columns an operator needs, under its own names: extra columns can't clash."""
    return df.select(*[df[f"`{src}`"].alias(dst) for dst, src in named.items()])


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings of ``column`` in one piece stay near ``budget`` bytes.

    A single longer text is a piece of its own; nothing is cut inside a text.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > budget:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text (null like the empty text)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
