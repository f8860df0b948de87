"""Tables that a query writes for itself, in the folder that the whole cluster shares.

A written table ends a lineage, so that a lost executor costs one stage and no more. It
stays until its query's result has been taken: ``temporary`` deletes what was written
within it but for what is kept, ``cleanup`` all that the application wrote.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go with the query that wrote them, as nothing reads them again.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folders: dict[str, str] = {}
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The application's folder under ``spark.checkpoint.dir``; a temporary one only in local mode, where that may be unset."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_folders.setdefault(app, "") or tempfile.mkdtemp(prefix="weir-")
        _own_folders[app] = base
    return f"{base.rstrip('/')}/weir/{app}"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_open, "made", []):
        made.add(path)
    return path


def write(df: DataFrame, path: str) -> None:
    """Writes Parquet."""
    spark = df.sparkSession
    if spark.conf.get(FILE_CLEANUP, "false") != "true":
        spark.conf.set(FILE_CLEANUP, "true")
    df.write.parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and it survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and left alone by the ``temporary`` around it."""
    path = fresh_path(df.sparkSession, name)
    for made in getattr(_open, "made", []):
        made.discard(path)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any longer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables written within, by this thread, go at the end."""
    made: set[str] = set()
    _open.made = [*getattr(_open, "made", []), made]
    try:
        yield
    finally:
        _open.made = [x for x in _open.made if x is not made]
        for path in made:
            drop_path(spark, path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all that the application has written."""
    drop_path(spark, shared_folder(spark))
