"""Tables and checkpoints in the folder that all executors share.

The folder is ``spark.checkpoint.dir``; a temporary one is made only where a local
session names none (tests).  What an application leaves there goes when it ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SWEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, also set as the checkpoint folder where none is."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (context.master or "").startswith("local") or (context.master or "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = context.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
        named = _OWN[app]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where it is absent."""
    files, at = _file_system(spark, path)
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file."""
    files, at = _file_system(spark, path)
    files.create(at, False).close()


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/shelfmark/{app}"
    if app not in _SWEPT:
        _SWEPT.add(app)
        files, at = _file_system(spark, folder)
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it needs to differ from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Spark's setting for removing a query's shuffle files as soon as it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each ends.

    Else they stay until the driver happens to collect its garbage, while the next
    step fills the disks.  Executors lost while such a query runs are no matter: the
    files are there until its end, and afterwards its table is read.
    """
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def table(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with _cleaned(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shelf_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables written by ``table`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "shelf_path", None)
        if path is not None:
            files, at = _file_system(df.sparkSession, path)
            files.delete(at, True)


class Scratch:
    """Tables of one operator: all but those that its result reads go when it is planned."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        self.made.append(table(df, label))
        return self.made[-1]

    def clear(self, *keep: DataFrame) -> None:
        drop(*[t for t in self.made if not any(t is k for k in keep)])
        self.made = [t for t in self.made if any(t is k for k in keep)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
