"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns under new names, by position: ``pick(df, k="doc_id")``.

    An exact match of the name wins over one that differs in case, and the
    first of several equal names wins, so extra columns that clash are harmless.
    """
    flat = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    out = [F.col(f"__c{place_of(df, old)}").alias(new) for new, old in columns.items()]
    return flat.select(*out)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset in a local session, as in tests, a temporary folder is made
    and set. On a cluster that is an error: other machines could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark's setting to delete a query's shuffle files as soon as it has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: its result is read from the shared folder from then on."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage there.

    Spark removes the files once nothing refers to the result any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    scratch_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_stored: list[tuple[SparkSession, str]] = []


def _remove_stored() -> None:
    for spark, path in _stored:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and its shared folder is for its owner to clear
            return


def remove_later(spark: SparkSession, path: str) -> None:
    """Remove a path when the driver ends."""
    if not _stored:
        atexit.register(_remove_stored)
    _stored.append((spark, path))


def store(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut`, as a Parquet table: smaller, and read by columns. Removed when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    remove_later(spark, path)
    with _tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column: the first of that very name, else the first that differs in case alone."""
    names = df.columns
    if name in names:
        return names.index(name)
    lower = [n.lower() for n in names]
    if name.lower() in lower:
        return lower.index(name.lower())
    raise ValueError(f"no column {name!r} among {names}")


def by_place(docs: DataFrame, stage: Callable[..., DataFrame], *columns: str) -> DataFrame:
    """``stage(flat, name, ...)`` on ``docs`` with its columns renamed by place, so that none clash; names are put back after it."""
    flat = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    out = stage(flat, *(f"__c{place_of(docs, c)}" for c in columns))
    return out.select(*flat.columns).toDF(*docs.columns)
