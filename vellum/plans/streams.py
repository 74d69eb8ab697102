"""Queries that run the events table as a stream, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import folder_for
from ..streaming import sessions as S
from .retrieval import DEDUP_SQL

#: How late an event may come.
LATE = 60
#: Seconds that a session of this table lasts idle, and that a request waits: its users send an event every few hours.
IDLE, WAIT = 5 * 86_400, 6 * 3_600


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parquet*")


def run(spark: SparkSession, name: str, out: DataFrame) -> DataFrame:
    """All that the stream out gives, as a table."""
    folder = folder_for(spark, name)
    with S.keyed_state(spark):
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def event_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_dedup on a stream: events of each kind and of four rooms of users, unless one was kept in the five minutes before."""
    e = events_stream(spark, sf_dir).withColumn("room", F.pmod("user_id", F.lit(4)))
    kept = S.once(e, ["room", "event_type"], "ts", "event_id", late=f"{LATE} seconds")
    return run(spark, "once", kept).select("event_id", "room", "event_type")


def file_events(events: DataFrame) -> DataFrame:
    """Events as those of files: a view brings one, a click asks for a comparison, a purchase ends it well and an error badly."""
    kind = F.create_map(*[F.lit(x) for pair in (("view", "file"), ("click", "ask"), ("purchase", "done"), ("error", "failed")) for x in pair])
    name = F.concat(F.lit("doc-"), "event_id", F.lit(".txt"))
    return events.select("user_id", "ts", kind[F.col("event_type")].alias("kind"), F.col("event_id").alias("message_id"), name.alias("file_name"), F.get_json_object("props", "$.k").alias("file_key"))


def told(files: Column) -> Column:
    return F.array_join(F.transform(files, lambda f: F.concat_ws(":", f["role"], f["file_name"], f["file_key"], f["message_id"].cast("string"))), " ")


def session_files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every user's sessions, with the files that it has by then."""
    out = S.file_sessions(file_events(events_stream(spark, sf_dir)), IDLE, WAIT, f"{LATE} seconds")
    changes = run(spark, "session-files", out)
    return changes.select("user_id", "session", "status", "n_files", F.unix_micros("at").alias("at"), told(F.col("files")).alias("files"))


def session_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes to each state, and of how many sessions; a session lasts a day and nobody asks."""
    events = file_events(events_stream(spark, sf_dir)).where("kind <> 'ask'")
    changes = run(spark, "sessions", S.file_sessions(events, 86_400, late=f"{LATE} seconds"))
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct("user_id", "session").alias("n_sessions"))


def machine_sql(idle: int, wait: int, asks: bool) -> str:
    """The changes of all sessions by stepping through each user's events, as (user_id, session, status, ids, t)."""
    idle, wait = idle * S.SECOND, wait * S.SECOND
    kinds = "CASE event_type WHEN 'view' THEN 'file' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'ask' END"
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, {kinds} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts,
  event_id) AS rn
  FROM events WHERE event_type IN ('view', 'purchase', 'error'{", 'click'" if asks else ""})),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS n, 'none' AS status, 0::BIGINT AS last, NULL::BIGINT AS until, false AS asked,
  []::BIGINT[] AS files,
  NULL::BIGINT AS went, 0::BIGINT AS went_n, []::BIGINT[] AS went_files, false AS said, 0::BIGINT AS t FROM e
 UNION ALL
 SELECT user_id, rn, n + opens::BIGINT, CASE WHEN opens THEN 'waiting' WHEN adds THEN 'processing' WHEN ends THEN kind ELSE status END, CASE
  WHEN opens OR adds OR ends THEN t ELSE last END,
  CASE WHEN opens OR adds OR ends THEN NULL WHEN asks THEN t + {wait} ELSE until END, asked AND NOT (opens OR adds OR ends),
  CASE WHEN opens THEN [event_id] WHEN adds THEN list_append(files, event_id) ELSE files END, went, n, went_files, opens OR adds OR ends, t
 FROM (SELECT *, kind = 'file' AND (status IN ('none', 'done', 'failed') OR asked) AS opens, kind = 'file' AND status IN ('waiting', 'processing')
  AND NOT asked AS adds,
   kind = 'ask' AND status = 'waiting' AND until IS NULL AS asks, kind IN ('done', 'failed') AND status = 'processing' AS ends
  FROM (SELECT user_id, rn, n, t, kind, event_id, went, went_files, CASE WHEN gone THEN 'none' ELSE status END AS status, last, CASE
  WHEN gone THEN NULL ELSE until END AS until,
    asked AND NOT gone AS asked, CASE WHEN gone THEN [] ELSE went_files END AS files
   FROM (SELECT *, status <> 'none' AND t >= last + {idle} AS gone
    FROM (SELECT s.user_id, e.rn, s.n, e.t, e.kind, e.event_id, CASE WHEN w THEN s.until END AS went, s.files AS went_files, CASE
  WHEN w THEN 'processing' ELSE s.status END AS status,
      CASE WHEN w THEN s.until ELSE s.last END AS last, CASE WHEN NOT w THEN s.until END AS until, s.asked OR w AS asked
     FROM (SELECT *, coalesce(until < last + {idle}, false) AS in_time FROM s) s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1,
  LATERAL (SELECT s.in_time AND s.until <= e.t AS w))))))
"""


def changes_sql(idle: int, wait: int, asks: bool) -> str:
    last_seen = f"(SELECT epoch_ms(max(ts)) * 1000 - {LATE * S.SECOND} FROM events)"
    return machine_sql(idle, wait, asks) + f""", c AS (SELECT user_id, n AS session, status, files AS ids, t FROM s WHERE said
 UNION ALL SELECT user_id, went_n, 'processing', went_files, went FROM s WHERE went IS NOT NULL
 UNION ALL SELECT user_id, n, 'processing', files, until FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS r FROM s)
  WHERE r = 1 AND until IS NOT NULL AND until < last + {idle * S.SECOND} AND until <= {last_seen})"""


SESSION_FILES_SQL = changes_sql(IDLE, WAIT, True) + """,
f AS (SELECT user_id, session, status, t, len(ids) AS n_files, unnest(ids) AS event_id, generate_subscripts(ids, 1) AS place FROM c),
p AS (SELECT event_id, props ->> '$.k' AS file_key FROM events)
SELECT user_id, session, status, n_files::INT AS n_files, t AS "at",
       string_agg(concat(CASE WHEN place = 1 THEN 'first' ELSE 'second' END, ':doc-', event_id, '.txt:', file_key, ':', event_id), ' ' ORDER BY place) AS files
FROM f JOIN p USING (event_id) GROUP BY ALL"""

STATES_SQL = changes_sql(86_400, S.SECOND_FILE_WAIT, False) + " SELECT status, count(*) AS n_changes, count(DISTINCT (user_id, session)) AS n_sessions FROM c GROUP BY status"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (event_dedup_stream, session_files_stream, session_state_machine)}
ORACLES = {"event_dedup_stream": DEDUP_SQL, "session_files_stream": SESSION_FILES_SQL, "session_state_machine": STATES_SQL}
