"""Stored tables that change: children replaced when their task runs again, keyed rows inserted, upserted and deleted.

Both kinds are Parquet folders whose partitions are overwritten one by one (dynamic partition overwrite), so a change writes the
partitions that it touches and no other file. A partition that loses its last row keeps one marker row, as an overwrite without rows
would leave the old ones. Every change can be made again with the same outcome, which is also what to do if it broke off. One
writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks the row that stands for a partition without rows.
NONE = "_none"
#: Partitions of a keyed table, by a hash of the key.
BUCKET, BUCKETS = "_bucket", 64


def _overwrite(df: DataFrame, path: str, partition: str) -> None:
    # rebalanced: a partition with very many rows is written by several tasks
    rows = df.hint("rebalance", partition)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType, partition: T.StructField) -> DataFrame:
    fields = [f for f in schema.fields if f.name != partition.name]
    return spark.read.schema(T.StructType([*fields, T.StructField(NONE, T.BooleanType()), partition])).parquet(path)


def rerun(rows: DataFrame, tasks: DataFrame, path: str, key: str = "task_id") -> None:
    """The children of tasks (key) in the table at path become rows; a task without rows has none then. Other tasks' files stay."""
    of = tasks.select(key).distinct()
    none = of.join(rows.select(key).distinct(), key, "left_anti").withColumn(NONE, F.lit(True))
    kept = rows.join(of, key, "left_semi").withColumn(NONE, F.lit(False))
    _overwrite(kept.unionByName(none, allowMissingColumns=True), path, key)


def children(spark: SparkSession, path: str, schema: T.StructType, key: str = "task_id") -> DataFrame:
    """The table at path; a filter on the key reads its tasks' files only."""
    return _read(spark, path, schema, schema[key]).where(~F.col(NONE)).select(*schema.names)


class Keyed:
    """A stored table of one row a key, in partitions by a hash of it (or of another column, so that children lie as their parents do)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, by: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.by, self.buckets = spark, path, schema, key, by or key, buckets

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value.cast("string")), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        return _read(self.spark, self.path, self.schema, T.StructField(BUCKET, T.IntegerType()))

    def rows(self) -> DataFrame:
        return self._all().where(~F.col(NONE)).select(*self.schema.names)

    def create(self, rows: DataFrame) -> None:
        self._put(rows, [*range(self.buckets)])

    def _put(self, rows: DataFrame, touched: list[int]) -> None:
        told = rows.select(*self.schema.names).withColumn(NONE, F.lit(False)).withColumn(BUCKET, self._bucket(F.col(self.by)))
        marks = self.spark.createDataFrame([(True, b) for b in touched], T.StructType([T.StructField(NONE, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())]))
        _overwrite(told.unionByName(marks, allowMissingColumns=True), self.path, BUCKET)

    def _touched(self, values: DataFrame, column: str) -> tuple[list[int], DataFrame]:
        """The partitions (self.buckets at most) that values of the column fall in, and their rows."""
        found = sorted(r[0] for r in values.select(self._bucket(F.col(column))).distinct().collect())
        return found, self._all().where(F.col(BUCKET).isin(found) & ~F.col(NONE)).select(*self.schema.names)

    def insert(self, rows: DataFrame) -> None:
        """Rows whose key isn't there yet; of several new rows of a key any one."""
        touched, old = self._touched(rows, self.by)
        new = rows.dropDuplicates([self.key]).join(old.select(self.key), self.key, "left_anti")
        self._put(old.unionByName(new.select(*self.schema.names)), touched)

    def upsert(self, changes: DataFrame, seq: str) -> None:
        """changes put in; of several of a key the one of the largest seq. The column of the partitions mustn't change."""
        touched, old = self._touched(changes, self.by)
        last = changes.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc(seq)))).where("_n = 1").select(*self.schema.names)
        self._put(old.join(last.select(self.key), self.key, "left_anti").select(*self.schema.names).unionByName(last), touched)

    def delete(self, gone: DataFrame, column: str | None = None) -> None:
        """Without the rows whose value of the column (that of the partitions) is in gone."""
        column = column or self.by
        touched, old = self._touched(gone, column)
        self._put(old.join(gone.select(column).distinct(), column, "left_anti"), touched)


def delete_cascade(parent: Keyed, gone: DataFrame, *kids: tuple[Keyed, str]) -> None:
    """The rows of gone (parent's key) and all rows of kids that name one of them; children first, so that none is left alone."""
    for table, foreign in kids:
        table.delete(gone.select(F.col(parent.key).alias(foreign)), foreign)
    parent.delete(gone)
