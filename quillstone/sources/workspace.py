"""Working tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and
Spark runs on one machine (tests, notebooks) is a temporary folder made and set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, set on first use where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Paths given out inside each ``tidy`` call that has not returned, the innermost last.
_given: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call has been given."""
    path = f"{shared_dir(spark)}/quillstone/{label}-{uuid.uuid4().hex}"
    if _given:
        _given[-1].append(path)
    return path


def roots(df: DataFrame) -> list[str]:
    """The folders and files that a DataFrame's plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            found += [paths.apply(k).toString() for k in range(paths.size())]
    return found


def tidy(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``run`` with its working tables removed on return, but those that its result still reads."""

    @wraps(run)
    def cleared(*args, **kwargs) -> DataFrame:
        own: list[str] = []
        _given.append(own)
        out, read = None, []
        try:
            out = run(*args, **kwargs)
            read = roots(out)
            return out
        finally:
            _given.pop()
            spark = SparkSession.getActiveSession()
            for path in own:
                name = path.rpartition("/")[2]
                if any(name in r for r in read):
                    if _given:
                        _given[-1].append(path)
                elif spark is not None:
                    delete(spark, path)

    return cleared


def materialise(df: DataFrame, label: str, replaces: DataFrame | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a reread, never a recomputation.  In a loop
    ``replaces`` names the round before, a result of this function that nothing but ``df``
    still reads; its table goes once the new one is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.working_path = path
    if replaces is not None and getattr(replaces, "__dict__", {}).get("working_path"):
        delete(spark, replaces.working_path)
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Remove a working table once nothing reads it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs started inside, put back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
