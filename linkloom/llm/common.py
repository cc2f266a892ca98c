"""Shared plumbing: scratch tables in the cluster's shared folder, partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: while a table is written: shuffles go with their job, and what goes to Python at once is small
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_tracked: ContextVar[list[str] | None] = ContextVar("tracked", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one
    is made only in local mode where the session names none (tests)."""
    path = spark.conf.get(_KEY, None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set(_KEY, path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/linkloom/{spark.sparkContext.applicationId}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (tracked := _tracked.get()) is not None:
        tracked.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes in the end the scratch tables made within; results must be written by then."""
    made: list[str] = []
    token = _tracked.set(made)
    try:
        yield
    finally:
        _tracked.reset(token)
        for path in made:
            delete(spark, path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the
    lineage, and lost executors cost nothing that was written.  The shuffles
    behind the table are deleted with the job's end."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = {k: spark.conf.get(k, None) for k in _WHILE}
    try:
        for k, v in _WHILE.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/linkloom/" in f}:
            delete(df.sparkSession, path)


def shuffle_parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of df's, case aside."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
