"""Reading tables, and cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: list[str] = []  # the folder used where spark.checkpoint.dir is unset
_PART = 8 << 20  # bytes of the files read for which fewer() leaves a partition
_GROUP_ROWS, _GROUP_BYTES = 1 << 16, 8 << 20  # a Python worker writes a row group when it holds so much


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Reads one of the tables through Spark, wherever its folder is."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``; where that is unset a temporary folder is used on a local master only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        _OWN[:] = _OWN or ["file://" + tempfile.mkdtemp(prefix="tessera-")]
        found = _OWN[0]
    return found.rstrip("/")


def fewer(df: DataFrame) -> DataFrame:
    """All rows of df in as many partitions as the files it reads need, two for each core at least; never more than it has.

    For plans whose shuffles hold about what those files hold, or less (no pairs with their texts).  Partitions become
    files, and on a local file system the executor's JVM starts three processes for each that it writes (chmod), which
    share all its memory until they run.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df.coalesce(min(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // _PART)), (1 << 31) - 1))


def written(df: DataFrame, name: str, few: bool = False, workers: bool = False, step: Step | None = None, schema: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage and survives lost executors.

    few: in as few files as fewer() says.  step and schema: df.mapInArrow(step, schema) is written.  workers: on a local
    file system the Python workers write the files, since an executor's JVM starts three processes for each (chmod of a
    folder, the file and its checksum); elsewhere Spark does.
    """
    spark = df.sparkSession
    df = fewer(df) if few else df
    made = df.mapInArrow(step, schema) if step else df
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    goes = lambda: _hadoop_path(spark, path, lambda system, target: system.deleteOnExit(target))  # what isn't dropped goes with the driver
    folder = _hadoop_path(spark, path, _local) if workers else None
    if folder:
        os.makedirs(f"{folder}/_tried")
        goes()
        # a task that is run again leaves files that no result names
        with _shuffles_dropped(spark):
            files = df.mapInArrow(_filed(f"{folder}/_tried", step), "file string").collect()
        for r in files:
            os.rename(f"{folder}/_tried/{r['file']}", f"{folder}/{r['file']}")
        shutil.rmtree(f"{folder}/_tried", ignore_errors=True)
    else:
        made.write.parquet(path)
        goes()
    back = spark.read.schema(made.schema).parquet(path)
    back._tessera_path = path
    return back


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made and collected inside lose their shuffle files at once, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _filed(folder: str, step: Step | None) -> Step:
    """Writes a partition as a Parquet file of its own and returns its name (nothing, if it has no rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"part-{uuid.uuid4().hex}.parquet"
        writer, held, rows, size = None, [], 0, 0

        def flush() -> None:
            nonlocal writer, held, rows, size
            if held:
                writer = writer or pq.ParquetWriter(f"{folder}/{file}", held[0].schema)
                writer.write_table(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0

        try:
            for b in step(batches) if step else batches:
                if b.num_rows:
                    held.append(b)
                    rows, size = rows + b.num_rows, size + b.nbytes
                    if rows >= _GROUP_ROWS or size >= _GROUP_BYTES:
                        flush()
            flush()
        finally:
            if writer:
                writer.close()
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([file])], ["file"])

    return run


def _local(system, target) -> str | None:
    """The folder as Python sees it, if it lies on a local file system."""
    return system.makeQualified(target).toUri().getPath() if system.getUri().getScheme() == "file" else None


def _hadoop_path(spark: SparkSession, path: str, do: Callable):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return do(target.getFileSystem(spark._jsc.hadoopConfiguration()), target)


def dropped(df: DataFrame) -> None:
    """Deletes what written() wrote; call it only when nothing lazy reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _hadoop_path(df.sparkSession, path, lambda system, target: system.delete(target, True))
