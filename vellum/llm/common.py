"""What the operators of this folder share: the shared work folder, tables in it, joins by size."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only while its measured bytes stay under this.
BROADCAST_BYTES = 16 << 20

#: White space between words, for Java's and RE2's patterns.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir.

    Without that setting a folder of this machine is made if the session is a local one; on a cluster it is an error,
    as every executor would write to its own disk and rows would be lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        base = getattr(spark, "_vellum_dir", None) or tempfile.mkdtemp(prefix="vellum-")
        spark._vellum_dir = base
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(id(spark.sparkContext), []).append(folder)
    return folder


#: Folders handed out, by context.
_FOLDERS: dict[int, list[str]] = {}


def clear_shared(spark: SparkSession) -> int:
    """Delete the folders that operators of this application have made; call it once their results are written."""
    folders, jvm = _FOLDERS.pop(id(spark.sparkContext), []), spark.sparkContext._jvm
    for f in folders:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of df's rows: 16 a row, eight a fixed-width value, and what strings, binaries and nested values hold."""
    size = F.lit(16).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + 8 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size = size + 8 + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 8
    return df.agg(F.sum(size)).first()[0] or 0


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it holds BROADCAST_BYTES at most, else as it is.

    df is a written table: its rows are counted in its footers, and its bytes are read only if so few rows may fit.
    """
    rows = df.count()
    small = rows * (16 + 8 * len(df.columns)) <= BROADCAST_BYTES and (rows == 0 or measured_bytes(df) <= BROADCAST_BYTES)
    return F.broadcast(df) if small else df


def added(row: DataFrame, made: dict[str, Column], columns: list[str]) -> DataFrame:
    """The columns of docs packed in row.row, and made; a column of docs that has a made one's name is replaced."""
    lower = {x.lower() for x in made}
    return row.select(*[F.col("row")[c].alias(c) for c in columns if c.lower() not in lower], *[c.alias(n) for n, c in made.items()])


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, named row, so that no name clashes with those of working columns."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda variable instead of a repeated expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_locator(df: DataFrame) -> bool:
    """Whether df's rows can be named by file and row, as those of a Parquet scan."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def give_back() -> None:
    """At a task's end: the free memory of its Python worker, which stays for later tasks, goes back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: Keys of a counted table that are broadcast at most: those that hold at least a HOT_KEYS-th of all rows.
HOT_KEYS = 100_000


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined with counted, a written table with one row a key whose column n tells at least how many of rows have it.

    total: the sum of n over all keys, at least. A small counted table is broadcast whole. Otherwise its hot keys are (there
    are HOT_KEYS of them at most), and the rest, none of which holds more than a HOT_KEYS-th of the rows, is joined by shuffle.
    """
    hinted = broadcast_if_small(counted)
    if hinted is not counted:
        return rows.join(hinted, on)
    hot = F.col(n) * HOT_KEYS >= F.lit(max(total, HOT_KEYS))
    return rows.join(F.broadcast(counted.where(hot)), on).unionByName(rows.join(counted.where(~hot), on))
