"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only while its measured bytes stay under this.
BROADCAST_BYTES = 16 << 20
#: Folders handed out, by context.
_FOLDERS: dict[int, list[str]] = {}


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; without that setting, of this machine for a local session and an error otherwise."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        base = tempfile.mkdtemp(prefix="vellum-")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(id(spark.sparkContext), []).append(folder)
    return folder


def clear_shared(spark: SparkSession) -> int:
    """Delete the folders that queries of this application have made; call it once their results are written."""
    folders = _FOLDERS.pop(id(spark.sparkContext), [])
    for f in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in such a folder: computed once, and not again when an executor is lost."""
    path = folder_for(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows hold BROADCAST_BYTES at most, else as it is; df is cheap to read twice."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
