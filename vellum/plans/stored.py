"""Queries over stored tables that change, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stored
from ..operators.shared import folder_for
from ..streaming import recovery
from .documents import table


def stored_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as risks of 16 tasks; tasks 3 and 5 run again, twice: the one gives fewer risks, the other none."""
    path = folder_for(spark, "children")
    lines = table(spark, sf_dir, "lineitem")
    risks = lines.select(F.pmod("l_orderkey", F.lit(16)).cast("int").alias("task_id"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("weight"))
    stored.rerun(risks, risks.select("task_id").distinct(), path)
    again = risks.where("task_id = 3 AND l_linenumber > 2").withColumn("weight", F.col("weight") * 2)
    tasks = spark.createDataFrame([(3,), (5,)], "task_id int")
    for _ in range(2):
        stored.rerun(again, tasks, path)
    out = stored.children(spark, path, risks.schema)
    return out.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_risks"), F.sum("weight").alias("weight"))


CHILDREN_SQL = """WITH r AS (SELECT (l_orderkey % 16)::INT AS task_id, l_linenumber, l_quantity AS weight FROM lineitem)
SELECT task_id, count(*) AS n_risks, sum(CASE WHEN task_id = 3 THEN 2 * weight ELSE weight END) AS weight FROM r WHERE task_id <> 5 AND (task_id <> 3
  OR l_linenumber > 2) GROUP BY task_id"""


def stored_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders as stored tables: some customers come again, some change, those of a nation go with their orders."""
    folder = folder_for(spark, "upkeep")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.lit(0).alias("version"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    parents = stored.Keyed(spark, f"{folder}/customers", c.schema, "c_custkey", buckets=16)
    kids = stored.Keyed(spark, f"{folder}/orders", o.schema, "o_orderkey", by="o_custkey", buckets=16)
    parents.create(c.where("c_custkey % 10 <> 0"))
    kids.create(o)
    parents.insert(c.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal")).otherwise(F.lit(-1.0))))
    changes = c.where("c_custkey % 7 = 0").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("c_acctbal", F.col("c_acctbal") + F.col("version"))
    parents.upsert(changes, "version")
    stored.delete_cascade(parents, parents.rows().where("c_nationkey = 3").select("c_custkey"), (kids, "o_custkey"))
    orders = kids.rows().groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    out = parents.rows().join(orders, "c_custkey", "full")
    return out.groupBy("c_nationkey", "version").agg(F.count("c_custkey").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"))


UPKEEP_SQL = """WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 2 ELSE c_acctbal END AS c_acctbal, CASE
  WHEN c_custkey % 7 = 0 THEN 2 ELSE 0 END AS version
 FROM customer WHERE c_nationkey <> 3),
o AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1)
SELECT c_nationkey, version, count(c_custkey) AS n_customers, round(sum(c_acctbal), 2) AS balance, coalesce(sum(n), 0)::BIGINT AS n_orders FROM c FULL
  JOIN o USING (c_custkey) GROUP BY ALL"""


def recovered_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks that a restart found: those unfinished are worked off (their line items are counted), those without a path fail."""
    folder = folder_for(spark, "recovery")
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parquet*")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    path = F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("/files/"), "o_orderkey")).otherwise(F.when(F.col("o_orderkey") % 2 == 0, " "))
    tasks = orders.select(F.col("o_orderkey").alias("task_id"), status.alias("status"), path.alias("file_path"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    work = lambda batch: batch.select("task_id").join(lines, "task_id", "left")
    for _ in range(2):  # the second start finds nothing to do
        recovery.take_up(tasks, work, f"{folder}/results", f"{folder}/checkpoint").awaitTermination()
    out = recovery.results_of(spark, f"{folder}/results", "task_id long, n_lines long, status string, message string")
    return out.select("task_id", "n_lines", "status", "message")


RECOVERED_SQL = f"""SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 11 <> 0 THEN n END AS n_lines, CASE
  WHEN o_orderkey % 11 <> 0 THEN 'completed' ELSE 'failed' END AS status,
CASE WHEN o_orderkey % 11 = 0 THEN '{recovery.NO_PATH}' END AS message
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'"""

QUERIES = {f.__name__: f for f in (stored_children, stored_upkeep, recovered_tasks)}
ORACLES = {"stored_children": CHILDREN_SQL, "stored_upkeep": UPKEEP_SQL, "recovered_tasks": RECOVERED_SQL}
