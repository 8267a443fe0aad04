"""The shared work folder: every lineage cut and every file that a query writes lies below ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """The URI of this application's folder below ``spark.checkpoint.dir``.

    Only a session on one machine gets a temporary folder without that setting; on a cluster it must name a shared one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        if sc.applicationId not in _OWN_ROOT:
            _OWN_ROOT[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="filigraph-")
        root = _OWN_ROOT[sc.applicationId]
    return f"{root.rstrip('/')}/filigraph-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the workspace that no other call gets."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that :func:`cut` made and that nothing reads any more."""
    if path := getattr(table, "_work_path", None):
        _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's work tables. Results that read them must be consumed before."""
    _delete(spark, workspace(spark))
