"""Exact dedup by a stateful stream.

Each row becomes (digest, id, locator); a streaming aggregation keyed by digest keeps, in a disk-backed state store without
expiry, the identifier and content locator of the row that stays, the locator of the row that came first and the number of rows
seen. Spark adds up each batch's rows per task before the shuffle, so a digest shared by a third of all rows reaches its state as
one row a task. Every hit (a row whose digest was seen more than once) is then held against the full text at the locator of the
first; rows that share a digest but not the bytes are grouped anew by their text.

The state may outlive a call: with state_dir a later call goes on from it, so rows of a new table are held against all rows that
earlier calls saw. Their texts are read from the very files that the locators name; where these are gone the call fails, and never
takes a digest's word for it. A call has a name (given, or made from its files and their times), under which its rows are written
once: the same call again changes nothing and says the same, and one that broke off is taken up where it stopped. A call reads the
updates of its own batches and the files that its hits name, so its cost doesn't grow with the calls before it.

Defined results: null text counts as empty; of equal texts the row with the largest id stays (a null id is smaller than any
other); of rows that repeat both id and text exactly one stays; an empty table gives an empty result; other columns are ignored,
whatever their names. With state_dir decisions are about the call's own rows, as its batches found them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, has_locator, shared_dir, table, written

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk reserved ahead
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


ROW = "id long, file string, row long, digest string, call long, column string"


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def _rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(new).getParent())
    if not fs.rename(path(old), path(new)):
        raise OSError(f"{old} can't be renamed to {new}")


def _last_batch(spark: SparkSession, folder: str) -> int:
    return max((int(x.split("=")[1]) for x in _files(spark, f"{folder}/updates") if x.startswith("batch=")), default=-1)


def keep_state(spark: SparkSession, folder: str, files_per_batch: int) -> None:
    """Run the stream over the rows under folder/rows that it hasn't read yet; each batch's updates go to folder/updates/batch=n.

    A batch that is run again after a failure overwrites its own updates. The stream's checkpoint remembers which files it
    has read, and its state goes on where it stopped.
    """
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/rows/*")
        first = F.min(F.struct("call", "file", "row", "column")).alias("first")
        state = stream.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keep"), first, F.count(F.lit(1)).alias("group_size"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


STATE = "digest string, keep struct<id:long,file:string,row:long>, first struct<call:long,file:string,row:long,column:string>, group_size long"


def _state_after(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """One row for each digest of the batches from low to high: its state after the last of them."""
    updates = [f"{folder}/updates/{x}" for x in _files(spark, f"{folder}/updates") if low <= int(x.split("=")[1]) <= high]
    seen = spark.read.schema(STATE).parquet(*updates) if updates else spark.createDataFrame([], STATE)
    # keep and group_size only grow, so the last update of a digest is its largest
    return seen.groupBy("digest").agg(F.max("keep").alias("keep"), F.min("first").alias("first"), F.max("group_size").alias("group_size"))


def _content(docs: DataFrame, id_col: str, text_col: str, folder: str) -> tuple[DataFrame, str]:
    """(id, text, file, row) of docs and the text's column: by docs' own files or, if it isn't a plain scan, by those of a copy."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    named = [F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")]
    if has_locator(docs):
        return docs.select(*named, *place), text_col
    return written(docs.select(*named), folder).select("*", *place), "text"


def _call_name(docs: DataFrame, id_col: str, text_col: str) -> str:
    """Of a plain scan, from its files, their sizes and times; else from its rows."""
    if has_locator(docs):
        of = docs.select(*[F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]).distinct()
    else:
        of = docs.select(F.col(f"`{id_col}`"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
    told = of.select(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(of.columns)])), 256).alias("h"))
    n, *sums = told.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(i), "h").cast("decimal(38,0)")) for i in range(2)]).first()
    return hashlib.sha256(repr((id_col, text_col, n, *map(str, sums))).encode()).hexdigest()[:32]


def _texts(spark: SparkSession, places: DataFrame) -> DataFrame:
    """places (file, row, column, ...) with the text that stands there; fails if a file is gone."""
    parts = None
    # as many names as the rows' tables have files
    files: dict[str, list[str]] = {}
    for r in places.select("column", "file").distinct().toLocalIterator():
        files.setdefault(r["column"], []).append(r["file"])
    for column, names in files.items():
        read = spark.read.parquet(*names).select(F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        part = read.join(broadcast_if_small(places.where(F.col("column") == column)), ["file", "row"])
        parts = part if parts is None else parts.unionByName(part)
    return places.withColumn("text", F.lit("")).where("false") if parts is None else parts


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int = 64, state_dir: str | None = None, call: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, file, row (its locator), digest, keep_id, group_size, kept.

    digest may be any function of the text column; rows are equal only if their whole texts are.
    state_dir: a shared folder whose state is gone on from, by one call at a time; call: this call's name.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "exact-dedup")
    stream = state_dir.rstrip("/") if state_dir else folder
    name = (call or _call_name(docs, id_col, text_col)) if state_dir else "only"
    content, column = _content(docs, id_col, text_col, f"{stream}/content/{name}" if state_dir else f"{folder}/content")
    content = content.withColumn("digest", digest(F.col("text")))

    earlier = _files(spark, f"{stream}/rows") if state_dir else []
    known = f"call={name}" in earlier
    if not known:
        new = content.select("id", "file", "row", "digest", F.lit(len(earlier)).cast("long").alias("call"), F.lit(column).alias("column"))
        written(new, f"{stream}/staging-{folder.rsplit('-', 1)[1]}")
        _rename(spark, f"{stream}/staging-{folder.rsplit('-', 1)[1]}", f"{stream}/rows/call={name}")
    rows = spark.read.schema(ROW).parquet(f"{stream}/rows/call={name}")
    if name in _files(spark, f"{stream}/calls"):
        low, high = spark.read.parquet(f"{stream}/calls/{name}").select("low", "high").first()
    else:
        low = 0 if known else _last_batch(spark, stream) + 1  # what a call that broke off has done may be in any batch
        keep_state(spark, stream, files_per_batch)
        high = _last_batch(spark, stream)
        spark.createDataFrame([(low, high)], "low long, high long").coalesce(1).write.mode("overwrite").parquet(f"{stream}/calls/{name}")
    kept = written(_state_after(spark, stream, low, high), f"{folder}/kept")
    number = rows.agg(F.max("call")).first()[0] or 0

    # full bytes on every hit: the text of the row that came first is fetched by its locator
    several = written(kept.where("group_size > 1"), f"{folder}/several")
    hits = content.join(broadcast_if_small(several), "digest")
    retained = hits.where("file = first.file AND row = first.row").select("digest", F.col("text").alias("retained"))
    if state_dir:
        old = rows.select("digest").distinct().join(several, "digest").where(F.col("first.call") < number)
        old = written(old.select("digest", "first.file", "first.row", "first.column"), f"{folder}/old")
        retained = retained.unionByName(_texts(spark, old).select("digest", F.col("text").alias("retained")))
        lost = several.join(rows.select("digest").distinct(), "digest", "left_semi").join(retained.select("digest"), "digest", "left_anti")
        if not lost.isEmpty():
            raise RuntimeError("the texts that some digests were first seen with aren't where they were")
    unequal = written(hits.join(retained, "digest").where("text <> retained").select("digest"), f"{folder}/unequal").distinct()
    joined = rows.select("id", "file", "row", "digest").join(kept, "digest")
    collide = not unequal.isEmpty()
    if collide:
        joined = joined.join(unequal, "digest", "left_anti")
    out = joined.select("id", "file", "row", "digest", "keep", "group_size")
    if collide:
        mixed = content.join(unequal, "digest", "left_semi").select("id", "file", "row", "digest", "text")
        seen = mixed
        if state_dir:
            history = spark.read.schema(ROW).parquet(*[f"{stream}/rows/{x}" for x in earlier]) if earlier else rows.limit(0)
            history = written(history.where(F.col("call") < number).join(unequal, "digest", "left_semi"), f"{folder}/history")
            seen = seen.unionByName(_texts(spark, history).select("id", "file", "row", "digest", "text"))
        exact = written(seen.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), f"{folder}/exact")
        out = out.unionByName(mixed.join(exact, ["digest", "text"]).select("id", "file", "row", "digest", "keep", "group_size"))
    stays = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return out.select(F.col("id").alias("doc_id"), "file", "row", "digest", F.col("keep.id").alias("keep_id"), "group_size", stays.alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns they came with."""
    spark = docs.sparkSession
    if not has_locator(docs):
        docs = written(docs, f"{shared_dir(spark, 'exact-dedup')}/docs")
    found = exact_dedup(docs, id_col, text_col)
    gone = written(found.where("NOT kept").select(F.col("file").alias("gone_file"), F.col("row").alias("gone_row")), f"{shared_dir(spark, 'exact-dedup')}/gone")
    place = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    left = place.join(broadcast_if_small(gone), (F.col("file") == F.col("gone_file")) & (F.col("row") == F.col("gone_row")), "left_anti")
    return left.select("doc.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
