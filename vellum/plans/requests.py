"""Queries over requests, decisions, headers and answers, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, mine, retrieve, rules, tables
from .documents import table
from .phrases import PHRASES, pick, pick_sql
from .retrieval import BM25_SQL, bm25_topk


def request_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests, line items as their pairs of versions; every third order's items count only if shipped in one mode."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"))
    kept = (F.col("l_orderkey") % 3 != 0) | (F.col("l_returnflag") == "N")
    text = lambda n: pick(PHRASES, F.col("l_orderkey") + F.col("l_linenumber") * n)
    pairs = table(spark, sf_dir, "lineitem").where(kept).select(F.col("l_orderkey").alias("request_id"), text(1).alias("before_text"), text(2).alias("after_text"))
    return mine.checked_requests(o, pairs).select("request_id", "n_pairs", "error")


BOUNDS_SQL = f"""WITH p AS (SELECT l_orderkey AS request_id, count(*) AS n,
  count(*) FILTER (WHERE {pick_sql(PHRASES, 'l_orderkey + l_linenumber')} = '' OR {pick_sql(PHRASES, 'l_orderkey + l_linenumber * 2')} = '') AS blank
 FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_returnflag = 'N' GROUP BY 1)
SELECT o_orderkey AS request_id, coalesce(n, 0) AS n_pairs, CASE WHEN coalesce(n, 0) NOT BETWEEN 1 AND 5 THEN 'a request has 1 to 5 pairs'
  WHEN blank > 0 THEN 'a text is blank' END AS error
FROM orders LEFT JOIN p ON request_id = o_orderkey"""


def bulk_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidates of orders; each customer's orders are decided on in bulk, some twice, some with a word that is refused."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("candidate_id"), F.lit("pending").alias("decision"))  # noqa: E741
    o = table(spark, sf_dir, "orders")
    first = o.select(F.col("o_orderkey").alias("task_id"), F.array(F.lit(1), F.lit(2), F.lit(9)).alias("ids"), pick(("included", "ignored", "no such"), "o_custkey").alias("decision"), F.lit(1).alias("request_id"))
    again = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("task_id"), F.array(F.lit(2), F.lit(3)).alias("ids"), F.lit("ignored").alias("decision"), F.lit(2).alias("request_id"))
    out = tables.decide_ids(l, first.unionByName(again))
    count = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return out.groupBy("task_id").agg(F.count(F.lit(1)).alias("total"), *[count(d) for d in tables.DECISIONS])


DECISIONS_SQL = """WITH c AS (SELECT l_orderkey AS task_id, CASE WHEN o_orderkey % 4 = 0 AND l_linenumber IN (2, 3) THEN 'ignored'
  WHEN l_linenumber IN (1, 2) AND o_custkey % 3 < 2 THEN ['included', 'ignored'][o_custkey % 3 + 1] ELSE 'pending' END AS decision FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey)
SELECT task_id, count(*) AS total, count(*) FILTER (WHERE decision = 'included') AS included, count(*) FILTER (WHERE decision = 'ignored') AS ignored,
  count(*) FILTER (WHERE decision = 'pending') AS pending
FROM c GROUP BY 1"""


def rule_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules whose fields go by English or Chinese names, some by both, some blank."""
    p = table(spark, sf_dir, "part")
    odd = F.col("p_partkey") % 2 == 1
    raw = p.select(
        "p_partkey", F.when(odd, F.concat(F.lit("R"), "p_partkey")).alias("rule_id"), F.when(~odd, F.concat(F.lit(" C"), "p_partkey")).alias("规则编号"),
        F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_brand")).alias("contract_type"), F.col("p_type").alias("合同类型"),
        pick(("财务审核", "法律", "p", None), "p_partkey").alias("module"), F.col("p_name").alias("风险名称"), F.col("p_size").alias("check_point"),
    )
    out = rules.named_fields(raw, keep=("p_partkey",))
    return out.select("p_partkey", "rule_code", "contract_type", "module", "risk_name", "check_point", "trigger_condition")


HEADERS_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'R' ELSE 'C' END || p_partkey AS rule_code, trim(CASE
  WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END) AS contract_type,
 CASE p_partkey % 4 WHEN 0 THEN '财务' WHEN 1 THEN '法务' ELSE '其他' END AS module, trim(p_name) AS risk_name, p_size::VARCHAR AS check_point,
  '' AS trigger_condition FROM part"""


def listed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules: those of one brand that are on, and how many a listing without any filter has."""
    r = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("contract_type"), (F.col("p_size") % 2 == 0).alias("enabled"))
    some = rules.list_rules(r, "Brand#12", True).withColumn("listing", F.lit("some"))
    every = rules.list_rules(r).withColumn("listing", F.lit("all"))
    return some.unionByName(every).groupBy("listing", "contract_type").agg(F.count(F.lit(1)).alias("n_rules"))


LISTED_SQL = """SELECT 'some' AS listing, p_brand AS contract_type, count(*) AS n_rules FROM part WHERE p_brand = 'Brand#12' AND p_size % 2 = 0 GROUP BY ALL
UNION ALL SELECT 'all', p_brand, count(*) FROM part GROUP BY ALL"""


def bm25_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of benchmark items in their order, with what is known of them, where they are still there."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id", "lang", "source", "n_chars")
    return retrieve.fetched(bm25_topk(spark, sf_dir), docs).select("query_id", "rank", "doc_id", "lang", "source", "n_chars")


RECORDS_SQL = f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank, doc_id, lang, source, n_chars
FROM ({BM25_SQL}) JOIN documents USING (doc_id) WHERE doc_id % 7 <> 0"""


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched for each order and module: the texts of its line items' differences, each once, in order."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    module = pick(("付款条款", "保密条款"), F.col("l_linenumber"))
    diffs = l.select("l_orderkey", module.alias("review_module"), F.col("l_linenumber").alias("n"), pick(PHRASES, "l_partkey").alias("before"), pick(PHRASES, "l_suppkey").alias("after"))
    return mine.retrieval_queries(diffs, ["l_orderkey"])


QUERY_TEXTS_SQL = f"""WITH d AS (SELECT l_orderkey, ['付款条款', '保密条款'][l_linenumber % 2 + 1] AS review_module, l_linenumber AS n,
  {pick_sql(PHRASES, 'l_partkey')} || ' ' || {pick_sql(PHRASES, 'l_suppkey')} AS t FROM lineitem),
o AS (SELECT l_orderkey, review_module, t, min(n) AS n FROM d GROUP BY ALL)
SELECT l_orderkey, review_module, string_agg(t, ' ' ORDER BY n, t) AS query FROM o GROUP BY ALL"""


def answer_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of their customers' cases: answers that differ in blanks, in order, in a risk or in a quote."""
    o = table(spark, sf_dir, "orders")
    k = F.pmod("o_orderkey", F.lit(5))
    one = lambda kind, quote, risk: F.concat(F.lit('{"change_type": "'), F.lit(kind), F.lit('", "old_quote": "'), quote, F.lit('", "risk_level": "'), risk, F.lit('"}'))
    first = one("added", F.when(k == 4, "x").otherwise("q"), F.lit("low"))
    second = one("deleted", F.lit("r"), F.when(k == 3, "high").otherwise("low"))
    items = F.when(k == 2, F.concat(second, F.lit(", "), first)).otherwise(F.concat(first, F.lit(", "), second))
    blank = F.when(k == 1, "  ").otherwise("")
    answer = F.concat(F.lit('{"success": true,'), blank, F.lit('"enhanced": ['), items, F.lit("]}"))
    out = metrics.answer_stability(o.select("o_custkey", answer.alias("answer")), "o_custkey", "answer")
    return out.select("o_custkey", "n_runs", *[F.round(f"{n}_rate", 6).alias(f"{n}_rate") for n in ("exact", "structure", "quotes")])


# runs 0 and 1 are one answer; 2 has its items the other way round, 3 another risk, 4 another quote
STABILITY_SQL = """WITH r AS (SELECT o_custkey, o_orderkey % 5 AS k FROM orders),
c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE k <= 1) AS k01, count(*) FILTER (WHERE k = 2) AS k2,
  count(*) FILTER (WHERE k = 3) AS k3, count(*) FILTER (WHERE k = 4) AS k4 FROM r GROUP BY 1)
SELECT o_custkey, n AS n_runs, round(greatest(k01, k2, k3, k4) / n, 6) AS exact_rate, round(greatest(k01 + k4, k2, k3) / n, 6) AS structure_rate,
  round(greatest(k01 + k2 + k3, k4) / n, 6) AS quotes_rate FROM c"""

QUERIES = {f.__name__: f for f in (request_bounds, bulk_decisions, rule_headers, listed_rules, bm25_records, query_texts, answer_stability)}
ORACLES = {
    "request_bounds": BOUNDS_SQL, "bulk_decisions": DECISIONS_SQL, "rule_headers": HEADERS_SQL, "listed_rules": LISTED_SQL, "bm25_records": RECORDS_SQL,
    "query_texts": QUERY_TEXTS_SQL, "answer_stability": STABILITY_SQL,
}
