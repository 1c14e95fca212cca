"""Tables that are written once and read often, and global row numbers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share; a temporary folder only where it is unset and
    the session is local (tests): on a cluster other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        made = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_kept: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    for spark, path in _kept:
        try:
            delete_path(spark, path)
        except Exception:  # the context is gone; the folder's owner clears it
            return


atexit.register(_clear)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the work folder, cleared when the driver's Python ends."""
    path = f"{work_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the work folder, cleared when the driver's Python ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if its files have fewer splits than there are cores.
    Inputs of more splits, large ones that is, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Many folders are listed by a few tasks a core meanwhile, not by a task each."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one small file through Hadoop's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content))
    out.close()


@dataclass(frozen=True)
class Entry:
    name: str
    is_folder: bool
    age: float  # seconds since its last change


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_folder(spark: SparkSession, path: str) -> list[Entry]:
    """What lies in a folder; nothing if there is none."""
    at, fs = _file_system(spark, path)
    now = time.time()
    # files that others move meanwhile are left out
    found = [s for s in (fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "*")) or []) if s is not None] if fs.exists(at) else []
    return sorted((Entry(s.getPath().getName(), s.isDirectory(), now - s.getModificationTime() / 1000) for s in found), key=lambda e: e.name)


def _moved(spark: SparkSession, text: str, path: str, over: bool) -> bool:
    """Write a small file under a name of its own and move it to path in one step; whether path was free, or `over`."""
    target, fs = _file_system(spark, path)
    target = fs.makeQualified(target)
    own = f"{path}.{uuid.uuid4().hex}.new"
    if fs.getScheme() == "file":  # Hadoop's moves of local files look before they leap, and move checksums apart
        at, own = target.toUri().getPath(), fs.makeQualified(_file_system(spark, own)[0]).toUri().getPath()
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        if over:
            os.replace(own, at)
            return True
        try:
            os.link(own, at)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    put_file(spark, own, text.encode())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, int(over))
    if over:
        how[0] = rename.OVERWRITE
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    source = fs.makeQualified(_file_system(spark, own)[0])
    try:
        files.rename(source, target, how)
    except Py4JJavaError as found:
        fs.delete(source, False)
        if "FileAlreadyExists" in found.java_exception.getClass().getName():
            return False
        raise
    return True


def write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """A small file with this text, put in place in one step: readers see the old text or the new, never a part."""
    _moved(spark, text, path, True)


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place in one step if there is none; whether it is this call's."""
    return _moved(spark, text, path, False)


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or none if there is no such file."""
    at, fs = _file_system(spark, path)
    if fs.getScheme() == "file":
        try:
            with open(fs.makeQualified(at).toUri().getPath(), encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return None
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def numbered(df: DataFrame, order: list[str], name: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with column `name`: 0, 1, 2, ... in the given total order.

    Rows are range-partitioned and sorted, written once with their place in their
    partition, and shifted by the sizes of the partitions before; only one count a
    partition reaches the driver, and no task sees more than its partition. then: a
    projection that makes rows of each row, in their order, before they are numbered.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = then(spread) if then else spread
    placed = saved(rows.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__k")), name)
    sizes = sorted((r["__p"], r["count"]) for r in placed.groupBy("__p").count().collect())
    shifts, total = [], 0
    for p, n in sizes:
        shifts.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(shifts, "__p int, __shift long")
    # one row a partition
    return spread_small(placed).join(F.broadcast(table), "__p").withColumn(name, F.col("__k") + F.col("__shift")).drop("__p", "__k", "__shift")
