"""Queries over the star-schema tables in the place of evaluated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases, evaluate
from .documents import table

_RISKS = ("pass", "high", "low")


def _risk(n):
    return F.get(F.array(*map(F.lit, _RISKS)), n)


def _found(spark, sf_dir):
    """Orders as expectations, their line items as the answer's items."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    items = l.select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey")).alias("pos"), F.format_string("R%d", F.col("l_partkey") % 40).alias("rule_code"),
        F.format_string("widget %d", F.col("l_partkey") % 7).alias("key"), _risk((F.col("l_partkey") % 3).cast("int")).alias("risk"),
    )
    asked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderkey").alias("expectation_id"), "o_orderpriority", F.format_string("R%d", F.col("o_custkey") % 40).alias("rule_code"),
        F.array(F.format_string("widget %d", F.col("o_custkey") % 7)).alias("key_aliases"), _risk((F.col("o_custkey") % 3).cast("int")).alias("risk_gold"),
        F.when(F.col("o_orderstatus") == "F", "defective").otherwise("standard").alias("quality_bucket"), (F.col("o_custkey") % 2 == 0).alias("expected_present"),
    )
    return evaluate.find_items(items, asked)


def expectation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well answers meet what was expected, by priority."""
    out = evaluate.expectation_rates(_found(spark, sf_dir), ["o_orderpriority"])
    return out.select("o_orderpriority", "n", "n_found", "risk_accuracy", "key_hit_rate", "false_negative_rate")


EXPECTATION_SQL = """WITH i AS (SELECT l_orderkey AS c, l_linenumber::BIGINT * 100000000 + l_partkey AS pos, 'R' || (l_partkey % 40) AS code,
  'widget ' || (l_partkey % 7) AS k, ['pass', 'high', 'low'][l_partkey % 3 + 1] AS risk FROM lineitem),
e AS (SELECT o_orderkey AS c, o_orderpriority, 'R' || (o_custkey % 40) AS code, 'widget ' || (o_custkey % 7) AS alias, ['pass', 'high',
  'low'][o_custkey % 3 + 1] AS gold, o_orderstatus = 'F' AND o_custkey % 2 = 0 AS needed FROM orders),
m AS (SELECT e.c, i.k, i.risk, row_number() OVER (PARTITION BY e.c ORDER BY CASE WHEN i.code = e.code THEN 0 ELSE 1 END, i.pos) AS n FROM e
  JOIN i ON e.c = i.c AND (i.code = e.code OR contains(i.k, e.alias) OR contains(e.alias, i.k))),
f AS (SELECT e.*, m.k, m.risk FROM e LEFT JOIN m ON e.c = m.c AND m.n = 1)
SELECT o_orderpriority, count(*) AS n, count(risk) AS n_found, round(count(*) FILTER (risk = gold) / nullif(count(risk), 0), 6) AS risk_accuracy,
  round(count(*) FILTER (contains(k, alias)) / count(*), 6) AS key_hit_rate,
round(count(*) FILTER (needed AND (risk IS NULL OR risk = 'pass')) / nullif(count(*) FILTER (needed), 0), 6) AS false_negative_rate FROM f GROUP BY 1"""


def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as runs: how often a later one has the first one's kind."""
    e = table(spark, sf_dir, "events").withColumn("all", F.lit("all"))
    return evaluate.run_stability(e, "user_id", "event_id", ["event_type"], ["all"])


RUN_STABILITY_SQL = """SELECT 'all' AS "all", round(count(*) FILTER (n > 1 AND event_type IS NOT DISTINCT FROM f) / count(*) FILTER (n > 1),
  6) AS event_type_stability
FROM (SELECT event_type, row_number() OVER w AS n, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the orders of the first status that has any: finished, open, pending."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return cases.standing_in(["o_custkey"], *[o.where(F.col("o_orderstatus") == s) for s in "FOP"]).select("o_custkey", "o_orderkey", "source")


FALLBACK_SQL = """SELECT o_custkey, o_orderkey, source FROM (SELECT *, min(source) OVER (PARTITION BY o_custkey) AS least FROM (SELECT o_custkey, o_orderkey, (strpos('FOP', o_orderstatus) - 1)::INTEGER AS source FROM orders WHERE o_orderstatus IN ('F', 'O', 'P'))) WHERE source = least"""

QUERIES = {"expectation_rates": expectation_rates, "run_stability": run_stability, "source_fallback": source_fallback}
ORACLES = {"expectation_rates": EXPECTATION_SQL, "run_stability": RUN_STABILITY_SQL, "source_fallback": FALLBACK_SQL}
