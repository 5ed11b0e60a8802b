"""Session settings, the shared folder, and cutting lineage with written tables."""

from __future__ import annotations

import atexit
import gc
import json
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_created: list[tuple[SparkSession, str]] = []


def session(app: str = "stratagraph", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and bench use."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.hadoop.parquet.page.verify-checksum.enabled": "true",  # damaged pages are an error, not wrong rows
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=base).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset a local session gets a temporary folder; a cluster session is an error,
    because a machine-local folder would lose data with its executor.
    """
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not (folder := getattr(spark.sparkContext, "_stratagraph_dir", None)):
        folder = spark.sparkContext._stratagraph_dir = "file://" + tempfile.mkdtemp(prefix="stratagraph-")
        _created.append((spark, folder))
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/stratagraph/{label}-{uuid.uuid4().hex}"
    _created.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    for spark, path in _created:
        try:
            HadoopFiles(spark, path).delete(path)
        except Exception:  # the JVM may be gone already
            return


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made within it: for drivers that live long. What is read from them must be written before it ends."""
    mark = len(_created)
    try:
        yield
    finally:
        for _, path in _created[mark:]:
            HadoopFiles(spark, path).delete(path)
        del _created[mark:]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes up to which an input of few files is spread over all cores.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is small and its files are too few to keep them busy; larger inputs split by themselves and pay no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and 0 < len(df.inputFiles()) < cores // 2 else df


#: Bytes on disk, and rows, up to which a table may be broadcast; columns of equal values compress so well that bytes alone tell little.
BROADCAST_BYTES, BROADCAST_ROWS = 1 << 20, 20_000


def disk_bytes(df: DataFrame) -> int:
    """The bytes of the tables that df reads, by the optimizer's statistics (of files: their sizes)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def is_small(df: DataFrame) -> bool:
    """True if what df reads is at most BROADCAST_BYTES on disk, and df has at most BROADCAST_ROWS rows."""
    return disk_bytes(df) <= BROADCAST_BYTES and df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def if_small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small; else the join shuffles, and AQE splits what is hot."""
    return F.broadcast(df) if is_small(df) else df


class HadoopFiles:
    """The few file operations publishing needs, on whatever file system the path names.

    durability: `commit` has every small file on disk before it counts, `interval` at most one a second, `never` leaves
    that to the file system.
    """

    def __init__(self, spark: SparkSession, root: str, durability: str = "commit"):
        if durability not in ("commit", "interval", "never"):
            raise ValueError(f"durability is commit, interval or never, not {durability!r}")
        self._durability, self._synced = durability, 0.0
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def move(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def mkdirs(self, path: str) -> bool:
        return self._fs.mkdirs(self._path(path))

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def list(self, path: str) -> list[str]:
        return [s.getPath().toString() for s in self._fs.listStatus(self._path(path))] if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = True) -> None:
        stream = self._fs.create(self._path(path), overwrite)
        try:
            stream.write(bytearray(text.encode()))
            if self._durability == "commit" or self._durability == "interval" and time.monotonic() - self._synced >= 1:
                stream.hsync()
                self._synced = time.monotonic()
        finally:
            stream.close()

    def swap(self, path: str, text: str) -> None:
        """Replaces a small file so that a reader sees the old or the new content, never a part."""
        tmp = f"{path}.{uuid.uuid4().hex}"
        self.write(tmp, text)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(self._path(tmp), self._path(path), options)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
