"""Tables written to the shared folder of the cluster, used to cut lineage.

Executors can be lost at any time, so nothing here relies on blocks that live
on one machine: a table is written as Parquet under ``spark.checkpoint.dir``
(which driver and executors share) and read back.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"


class Written:
    """A table in the shared folder: ``df`` reads it, ``drop()`` deletes its files."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)  # a known schema needs no look at the files

    def drop(self) -> None:
        delete(self.spark, self.path)


class _Scratch(threading.local):
    """Tables written inside each open ``scratch`` block of this thread."""

    def __init__(self) -> None:
        self.levels: list[list[Written]] = []


_SCRATCH = _Scratch()


def write(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> Written:
    """Write ``df`` once and return the written table; ``keep`` lets it outlive the innermost ``scratch`` block (not those around it)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = Written(spark, path, df.schema)
    level = len(_SCRATCH.levels) - 1 - keep
    if level >= 0:
        _SCRATCH.levels[level].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end; what is to stay is written with ``keep`` or elsewhere by then (a stage's output)."""
    _SCRATCH.levels.append([])
    try:
        yield
    finally:
        for table in _SCRATCH.levels.pop():
            table.drop()


@contextmanager
def owned() -> Iterator[list[Written]]:
    """Tables written inside are given to the caller, who drops them; they outlive ``scratch`` blocks around."""
    _SCRATCH.levels.append([])
    out: list[Written] = []
    try:
        yield out
    finally:
        out += _SCRATCH.levels.pop()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside hand Python workers at most ``rows`` rows at a time, for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# --- files and folders by their names, in whatever store the path is in


def hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = hadoop(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    fs, where = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def extent(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, bytes) of the data files in a folder and its subfolders; (0, 0) where there is none."""
    fs, where = hadoop(spark, path)
    if not fs.exists(where):
        return 0, 0
    found, files, size = fs.listFiles(where, True), 0, 0
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith(("_", ".")):
            files, size = files + 1, size + status.getLen()
    return files, size


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all: it gets its name when it is written."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    fs, where = hadoop(spark, part)
    stream = fs.create(where)
    stream.write(text.encode())
    stream.close()
    if not fs.rename(where, hadoop(spark, path)[1]):
        fs.delete(where, False)
        raise FileExistsError(path)


def get_text(spark: SparkSession, path: str) -> str:
    fs, where = hadoop(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
