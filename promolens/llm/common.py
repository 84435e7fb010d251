"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship_by_value(name: str) -> None:
    """Send a module's functions to the executors by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship_by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local
    master gets a folder of its own; on a cluster executors would each write to their own disk, so that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str, default: str) -> Iterator[None]:
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Within it, an action's shuffle files go as soon as the action ends. For actions that end a lineage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true", "false")


def small_batches(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager:
    """Within it, an action hands Python so many rows at a time, so that workers hold fewer long texts."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows), "10000")


def sorted_buckets(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Within it, a bucket that is one sorted file, as save_buckets() writes it, isn't sorted again for a join."""
    return setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true", "false")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and later
    stages see one fixed result even if executors are lost."""
    return df.sparkSession.read.schema(df.schema).parquet(save_path(df, name))


def save_path(df: DataFrame, name: str) -> str:
    """Write df to the shared folder; the path there."""
    path = fresh_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return path


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def share(spark: SparkSession, name: str, arrays: list[np.ndarray]) -> str:
    """The path of arrays written to the shared folder, where shared_arrays() finds them: one copy for all
    executors, for models of bounded size that would else lie on each executor's disk."""
    path = fresh_path(spark, name)
    fs, folder = open_fs(path)
    fs.create_dir(folder, recursive=True)
    for i, a in enumerate(arrays):
        batch = pa.RecordBatch.from_arrays([pa.array(a)], ["x"])
        with fs.open_output_stream(f"{folder}/{i}", compression=None) as out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
    return f"{path}/{len(arrays)}"


_SHARED: dict[str, list[np.ndarray]] = {}


def shared_arrays(path: str) -> list[np.ndarray]:
    """What share() wrote; a task reads it once and keeps the last."""
    if path not in _SHARED:
        _SHARED.clear()
        uri, n = path.rsplit("/", 1)
        fs, folder = open_fs(uri)
        made = []
        for i in range(int(n)):
            with fs.open_input_stream(f"{folder}/{i}", compression=None) as stream:
                made.append(pa.ipc.open_stream(stream).read_all().column(0).combine_chunks().to_numpy())
        _SHARED[path] = made
    return _SHARED[path]


def kept(key: str, make: Callable[[], Any]) -> Any:
    """make(), which a worker calls once for all its tasks; it keeps the last that it made. Functions that are
    shipped by value have new globals in each task, so this lies in a module of the worker's own."""
    held = vars(sys).setdefault("_promolens_kept", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def saved_files(path: str) -> Iterator[pa.Table]:
    """What save_path() wrote, file by file, as a task reads it itself: for tables of bounded size that each
    worker holds, which so pass neither through the driver nor lie on each executor's disk."""
    fs, folder = open_fs(path)
    for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda info: info.path):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                yield pq.ParquetFile(file).read(use_threads=False)


def saved_arrays(path: str, *names: str) -> list[np.ndarray]:
    """Columns of what save_path() wrote; nulls are zeros."""
    parts = [[pc.fill_null(t.column(c), 0).to_numpy() for c in names] for t in saved_files(path)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def discard(df: DataFrame) -> None:
    """Delete a table that save() wrote and that nothing reads any more."""
    if files := df.inputFiles():
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def save_buckets(df: DataFrame, name: str, *key: str) -> DataFrame:
    """The same as a table in buckets by `key`, as many as shuffles have partitions: joins on the key leave it in place.
    The catalog, which alone makes buckets, forgets the table at once; its files stay."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    buckets, made = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    with tidy(spark):
        # sorted keys lie close together: version 2 of the format stores their differences
        # by the key alone they are sorted as numbers; the writer's sort by bucket and key then finds them in order
        write = df.sortWithinPartitions(*key).write.bucketBy(buckets, *key).sortBy(*key).option("path", path)
        write.option("compression", "zstd").option("parquet.writer.version", "v2").saveAsTable(made)
    out = spark.table(made)
    spark.sql(f"DROP TABLE {made}")
    return out


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """schema with fields added; an input column of the same name is replaced."""
    new = {f.name for f in fields}
    return T.StructType([f for f in schema if f.name not in new] + list(fields))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that a worker holds the Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most `limit` bytes in column `name`, or with one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")), at + 1)
            yield batch.slice(at, end - at)
            at = end
