"""Line dedup: lines that stand in several documents are kept in the first of these only.

The lines of all documents are exploded; a line's key is the line stripped of white space at both ends, with A-Z in lower
case. Keys are hashed to 128 bits, the distinct documents of each hash are counted, and the lines of a hash with
min_docs documents or more go, but for those of the least document that holds it. A document is put together again
from the runs of lines between the places that it loses.

Counting adds up within each task before rows move, so a line in every document reaches its counter as one row a task and
document. The counted hashes go back to the lines by a broadcast where they are few; otherwise only the hottest hashes, whose
number is bounded, are broadcast, and no other can skew the shuffle.

Defined results: null text counts as empty, which is one empty line; rows of one id are one document, so a line that only they
hold stays in all of them; rows without an id are one document, the last of all; a line that a document repeats stays or goes
at all its places; a document that loses all its lines has an empty text; an empty table gives an empty result; the other
columns come through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, has_locator, join_counted, let, packed, shared_dir, table, written

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, MIN_CHARS = 2, 10
#: A row without an id counts as one with this.
NO_ID = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def without(lines: Column, places: Column) -> Column:
    """lines joined, but for those at places (from 0, ascending)."""
    starts, ends = F.concat(F.array(F.lit(-1)), places), F.concat(places, F.array(F.size(lines)))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(runs), "\n")


def repeated_lines(base: DataFrame, folder: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(file, at, places): the places of the lines that go, one row for each row of base (file, at, id, text) that loses any."""
    lines = base.select("file", "at", "id", F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    keyed = lines.select("file", "at", "id", "place", F.btrim("line", F.lit(BLANK)).alias("key")).where(F.length("key") >= min_chars)
    key = F.translate("key", UPPER, LOWER)
    # two hashes of 64 bits, as one isn't enough to tell 10^12 lines apart
    hashed = keyed.select("file", "at", "id", "place", F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))
    hashed = written(hashed, f"{folder}/lines")
    met = hashed.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n_docs"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    several = written(met.where(F.col("n_docs") >= min_docs).select("h1", "h2", "first_id", "n"), f"{folder}/several")
    gone = join_counted(hashed, several, ["h1", "h2"], "n", hashed.count()).where("id <> first_id")
    places = gone.groupBy("file", "at").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return written(places, f"{folder}/places")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each row of docs: row (its columns as a struct), n_lines, places (of the lines that go), kept (the text left)."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "line-dedup")
    if not has_locator(docs):
        docs = written(docs, f"{folder}/docs")
    # files are told apart by a hash of their paths: there are far fewer of them than rows
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    id, text = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), F.col(f"`{text_col}`")
    places = repeated_lines(docs.select(*place, id.alias("id"), text.alias("text")), folder, min_docs, min_chars)
    joined = docs.select(packed(docs), *place).join(broadcast_if_small(places), ["file", "at"], "left")

    def made(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), F.when(F.col("places").isNotNull(), without(lines, F.col("places"))).alias("kept"))

    whole = F.coalesce(F.col("row")[text_col], F.lit(""))
    told = joined.select("row", F.coalesce("places", F.array().cast("array<int>")).alias("gone"), let(lines_of(whole), made).alias("made"))
    return told.select("row", "made.n_lines", F.col("gone").alias("places"), F.coalesce("made.kept", F.coalesce(F.col("row")[text_col], F.lit(""))).alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with what is left of each text; a null text stays null."""
    made = dedup_lines(docs, id_col, text_col, min_docs, min_chars)
    left = F.when(F.col("row")[text_col].isNotNull(), F.col("kept"))
    return made.select(*[left.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("row.doc_id", "n_lines", F.size("places").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
several AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
told AS (SELECT k.*, coalesce(k.doc_id <> first_id, false) AS gone FROM k LEFT JOIN several USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
