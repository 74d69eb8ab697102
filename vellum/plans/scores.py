"""Queries over the star schema in the place of evaluated runs: form checks, counts for each case, scores, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import evaluate, metrics, scoring
from .documents import table
from .phrases import PHRASES, in_sql, pick, pick_sql

_QUOTES = PHRASES[:6]
_KINDS = ("added", "deleted", "modified")


def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scored rules and dense samples; their scores, counted."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        (k % 2 == 0).alias("generation_ok"), (k % 3 == 0).alias("review_module_hit"), F.when(k % 5 != 0, k % 4 == 0).alias("risk_hit"), (k % 7 < 3).alias("trigger_hit"), (k % 11 < 5).alias("suggestion_hit"),
        (k % 13 < 9).alias("trace_evidence_accuracy"), (k % 2 == 1).alias("schema_ok"), F.lit(True).alias("backend_fields_clean"), ((k % 10) / 10).alias("expected_rule_coverage"), ((k % 8) / 8).alias("usable_rule_precision"), ((k % 4) / 4).alias("split_accuracy"),
    )
    s = p.select(F.round(scoring.weighted_score(), 6).alias("score"), F.round(scoring.weighted_score(scoring.DENSE_WEIGHTS), 6).alias("dense_score"))
    return s.groupBy("score", "dense_score").agg(F.count(F.lit(1)).alias("n_rows"))


WEIGHTED_SQL = """WITH k AS (SELECT p_partkey AS k FROM part),
f AS (SELECT (k % 2 = 0)::INT AS a, (k % 3 = 0)::INT AS b, coalesce(CASE WHEN k % 5 <> 0 THEN (k % 4 = 0)::INT END, 0) AS c, (k % 7 < 3)::INT AS d,
  (k % 11 < 5)::INT AS e, (k % 13 < 9)::INT AS t, (k % 2 = 1)::INT AS s, (k % 10) / 10 AS x, (k % 8) / 8 AS y, (k % 4) / 4 AS z FROM k)
SELECT round(0.25::DOUBLE * a + 0.15::DOUBLE * b + 0.15::DOUBLE * c + 0.15::DOUBLE * d + 0.1::DOUBLE * e + 0.1::DOUBLE * t + 0.05::DOUBLE * s +
  0.05::DOUBLE, 6) AS score,
 round(0.35::DOUBLE * x + 0.3::DOUBLE * y + 0.2::DOUBLE * z + 0.05::DOUBLE * s + 0.05::DOUBLE + 0.05::DOUBLE * t, 6) AS dense_score,
  count(*) AS n_rows FROM f GROUP BY ALL"""

def form_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results whose fields are well or ill formed independently of one another; what is wrong with each, counted."""
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    kind, risk = F.when(i % 7 == 0, "turned").otherwise("moved"), F.when(i % 11 == 0, "dire").otherwise("low")
    more = "".join(f', "{n}": ""' for n in ("original", "old_quote", "new_quote", "category", "summary", "evidence", "impact", "suggestion"))
    whole = F.concat(F.lit('[{"change_type": "'), kind, F.lit('", "risk_level": "'), risk, F.lit('"' + more + "}]"))
    enhanced = F.when(u % 4 == 0, whole).when(u % 4 == 1, "[]").when(u % 4 == 2, "{}").otherwise('[{"change_type": "added"}]')
    body = F.concat(
        F.lit("{"), F.when(i % 3 == 0, '"success": true, ').when(i % 3 == 1, '"success": "yes", ').otherwise(""), F.lit('"enhanced": '), enhanced,
        F.lit(', "total_risks": '), F.when(i % 5 == 0, '"1"').otherwise("1"), F.lit(', "message": '), F.when(i % 2 == 0, '"m"').otherwise("null"),
        F.when(i % 13 == 0, ', "more": 1').otherwise(""), F.lit("}"),
    )
    return e.select(F.array_join(scoring.form_errors(body), ",").alias("errors")).groupBy("errors").agg(F.count(F.lit(1)).alias("n_results"))


FORM_SQL = """SELECT concat_ws(',', CASE WHEN event_id % 3 = 2 OR event_id % 13 = 0 THEN 'top_level_fields' END, CASE WHEN event_id % 3 <> 0 THEN 'success_type' END,
  CASE WHEN event_id % 5 = 0 THEN 'total_risks_type' END, CASE WHEN event_id % 2 = 1 THEN 'message_type' END, CASE WHEN user_id % 4 = 2 THEN 'enhanced_not_list' END,
  CASE WHEN user_id % 4 = 3 THEN 'item_fields' END, CASE WHEN user_id % 4 = 0 AND event_id % 7 = 0 THEN 'change_type' END,
  CASE WHEN user_id % 4 = 3 OR user_id % 4 = 0 AND event_id % 11 = 0 THEN 'risk_level' END) AS errors, count(*) AS n_results
FROM events GROUP BY ALL"""


def _compared(spark, sf_dir):
    """Customers as cases; orders with an even key as gold differences, the others as found ones."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    cases = c.select(k.alias("case_id"), "c_nationkey", F.concat(pick(PHRASES, k), pick(PHRASES, k + 1)).alias("old_text"), F.concat(pick(PHRASES, k), pick(PHRASES, k + 2)).alias("new_text"), (k % 5 != 0).alias("success"), (k % 3).alias("total_risks"), (k % 2).alias("expected_total_risks"))
    o, n = table(spark, sf_dir, "orders"), F.floor(F.col("o_orderkey") / 2)
    kind, old, new = pick(_KINDS, n), pick((*_QUOTES, ""), n), pick((*_QUOTES, ""), n + F.col("o_custkey"))
    gold = o.where("o_orderkey % 2 = 0").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("gold_id"), kind.alias("change_type"), F.when(kind == "added", "").otherwise(old).alias("old_quote"), F.when(kind == "deleted", "").otherwise(new).alias("new_quote"),
        F.array(F.array(F.lit("甲方"), F.lit("合同")), F.array(F.lit("付款"), F.lit("解除"))).alias("required_facts"), F.array(F.lit("付款条款"), F.lit("解除终止")).alias("categories"), F.array(F.lit("medium")).alias("risk_levels"),
        pick(("rule_template", "default_review", "default_format", "any"), n).alias("suggestion_mode"), pick(("建议", ""), n).alias("suggestion_template"), F.lit(None).cast("string").alias("original"),
    )
    found = o.where("o_orderkey % 2 = 1").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("found_id"), kind.alias("change_type"), F.when((kind == "added") & (n % 4 != 0), "").otherwise(old).alias("old_quote"), F.when((kind == "deleted") & (n % 4 != 0), "").otherwise(new).alias("new_quote"),
        F.concat(old, new).alias("original"), labels.diff_category(F.lit(""), old, new, kind).alias("category"), pick(("low", "medium"), n).alias("risk_level"), pick((scoring.REVIEW_ZH, scoring.FORMAT_ZH, ""), n).alias("suggestion"),
    )
    return cases, gold, found


def compare_case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every case."""
    return scoring.case_counts(*_compared(spark, sf_dir))


def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the cases of each nation, and their rates."""
    cases, gold, found = _compared(spark, sf_dir)
    counts = scoring.case_counts(cases, gold, found).join(cases.select("case_id", "c_nationkey"), "case_id")
    return scoring.summed(counts, ["c_nationkey"])


def _category_sql(t):
    from .phrases import cascade_sql

    return cascade_sql(t, labels.CATEGORIES_ZH, "'其他'")


_Q7 = (*_QUOTES, "")
_COMPARED = f"""n AS (SELECT o_custkey AS case_id, o_orderkey, o_orderkey // 2 AS n FROM orders),
v AS (SELECT *, {pick_sql(_KINDS, 'n')} AS kind, {pick_sql(_Q7, 'n')} AS o, {pick_sql(_Q7, 'n + case_id')} AS w FROM n),
g AS (SELECT case_id, o_orderkey AS gold_id, n, kind, CASE WHEN kind = 'added' THEN '' ELSE o END AS oq, CASE WHEN kind = 'deleted' THEN ''
  ELSE w END AS nq FROM v WHERE o_orderkey % 2 = 0),
f AS (SELECT case_id, o_orderkey AS found_id, n, kind, CASE WHEN kind = 'added' AND n % 4 <> 0 THEN '' ELSE o END AS oq, CASE WHEN kind = 'deleted'
  AND n % 4 <> 0 THEN '' ELSE w END AS nq, o || w AS original, {_category_sql('o || w')} AS category,
 {pick_sql(("low", "medium"), 'n')} AS risk_level, {pick_sql((scoring.REVIEW_ZH, scoring.FORMAT_ZH, ""), 'n')} AS suggestion FROM v WHERE o_orderkey % 2 = 1),
gn AS (SELECT *, row_number() OVER (PARTITION BY case_id, kind, oq, nq ORDER BY gold_id) AS i FROM g),
fn AS (SELECT *, row_number() OVER (PARTITION BY case_id, kind, oq, nq ORDER BY found_id) AS i FROM f WHERE NOT (kind = 'added' AND oq <> '')
  AND NOT (kind = 'deleted' AND nq <> '')),
m AS (SELECT gn.case_id, gn.n AS gnum, fn.* EXCLUDE (case_id) FROM gn JOIN fn ON gn.case_id = fn.case_id AND gn.kind = fn.kind AND gn.oq = fn.oq
  AND gn.nq = fn.nq AND gn.i = fn.i),
mh AS (SELECT case_id, count(*) AS matched_diff_total, count(*) AS matched_quote_preserved, count(*) FILTER ((contains(original, '甲方')
  OR contains(original, '合同')) AND (contains(original, '付款') OR contains(original, '解除'))) AS matched_original_fact_hits,
 count(*) FILTER (category IN ('付款条款', '解除终止')) AS matched_category_hits, count(*) FILTER (risk_level = 'medium') AS matched_risk_level_hits,
 count(*) FILTER (CASE gnum % 4 WHEN 0 THEN gnum % 2 = 0 AND contains(suggestion, '建议') WHEN 1 THEN suggestion = '{scoring.REVIEW_ZH}'
  WHEN 2 THEN suggestion = '{scoring.FORMAT_ZH}' ELSE true END) AS matched_suggestion_hits FROM m GROUP BY 1),
c AS (SELECT c_custkey AS case_id, c_nationkey, {pick_sql(PHRASES, 'c_custkey')} || {pick_sql(PHRASES, 'c_custkey + 1')} AS old_text,
  {pick_sql(PHRASES, 'c_custkey')} || {pick_sql(PHRASES, 'c_custkey + 2')} AS new_text, c_custkey % 5 <> 0 AS success,
  c_custkey % 3 = c_custkey % 2 AS agree FROM customer),
q AS (SELECT f.case_id, count(*) AS pred_diff_total, count(*) FILTER (oq <> '') AS old_quote_hit_total, count(*) FILTER (oq <> ''
  AND contains(old_text, oq)) AS old_quote_hits, count(*) FILTER (nq <> '') AS new_quote_hit_total, count(*) FILTER (nq <> '' AND contains(new_text,
  nq)) AS new_quote_hits FROM f JOIN c USING (case_id) GROUP BY 1),
gt AS (SELECT case_id, count(*) AS gold_diff_total FROM g GROUP BY 1)"""
_COUNTS = (
    "gold_diff_total", "pred_diff_total", "old_quote_hit_total", "old_quote_hits", "new_quote_hit_total", "new_quote_hits",
    "matched_diff_total", "matched_quote_preserved", "matched_original_fact_hits", "matched_category_hits", "matched_risk_level_hits",
    "matched_suggestion_hits",
)
_CASES = f"{_COMPARED}, cc AS (SELECT case_id, c_nationkey, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNTS)}, success::BIGINT AS success_case_total, (success AND agree)::BIGINT AS total_risks_hits FROM c LEFT JOIN gt USING (case_id) LEFT JOIN q USING (case_id) LEFT JOIN mh USING (case_id))"
COMPARE_COUNTS_SQL = f"WITH {_CASES} SELECT * EXCLUDE (c_nationkey) FROM cc"
_ALL = [*_COUNTS, "success_case_total", "total_risks_hits"]
_RATES = {"recall": ("matched_diff_total", "gold_diff_total"), "precision": ("matched_diff_total", "pred_diff_total"), "risk_level_accuracy": ("matched_risk_level_hits", "matched_diff_total"), "old_quote_rate": ("old_quote_hits", "old_quote_hit_total"), "total_risks_accuracy": ("total_risks_hits", "success_case_total")}
COMPARE_SUMMARY_SQL = f"WITH {_CASES}, s AS (SELECT c_nationkey, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _ALL)} FROM cc GROUP BY 1) SELECT *, {', '.join(f'round(coalesce({a} / nullif({b}, 0), 1.0), 6) AS {n}' for n, (a, b) in _RATES.items())} FROM s"


def stub_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold differences answered by themselves: all are matched."""
    cases, gold, _ = _compared(spark, sf_dir)
    out = scoring.case_counts(cases, gold, scoring.stub_outputs(gold))
    return out.select("case_id", "gold_diff_total", "pred_diff_total", "matched_diff_total", "matched_original_fact_hits")


STUB_SQL = f"WITH {_COMPARED} SELECT case_id, coalesce(gold_diff_total, 0) AS gold_diff_total, coalesce(gold_diff_total, 0) AS pred_diff_total, coalesce(gold_diff_total, 0) AS matched_diff_total, coalesce(gold_diff_total, 0) AS matched_original_fact_hits FROM c LEFT JOIN gt USING (case_id)"


def trace_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as samples, orders as differences, every third one's expectation and every other one's rule."""
    o = table(spark, sf_dir, "orders")
    k, sample = F.col("o_orderkey"), F.col("o_custkey").alias("sample_id")
    before, after = pick(PHRASES, "o_orderkey"), pick(PHRASES, "o_custkey")
    diffs = o.select(sample, k.alias("diff_id"), F.when(k % 2 == 0, "Pay").otherwise("Term").alias("review_module"), pick(_KINDS, "o_orderkey").alias("change_type"), before.alias("before"), after.alias("after"), (k % 5 > 1).alias("is_substantive"))
    expected = o.where("o_orderkey % 3 = 0").select(sample, k.alias("rule_id"), F.array(F.lit("pay"), F.lit("PAY")).alias("modules"), pick(("added", None), "o_orderkey").alias("change_type"), F.array(F.lit("甲方"), F.lit("付款"), F.lit("合同")).alias("keywords"))
    rules = o.where("o_orderkey % 2 = 1").select(sample, k.alias("rule_id"), pick(("d", "", None), k).alias("source_diff_id"), before.alias("evidence_before"), after.alias("evidence_after"), (k % 7 < 4).alias("valid"))
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    return scoring.trace_diagnostics(samples, diffs, expected, rules)


TRACE_SQL = f"""WITH o AS (SELECT o_custkey AS s, o_orderkey AS k, {pick_sql(PHRASES, 'o_orderkey')} AS b, {pick_sql(PHRASES, 'o_custkey')} AS a,
  {pick_sql(_KINDS, 'o_orderkey')} AS kind, o_orderkey % 5 > 1 AS sub FROM orders),
d AS (SELECT s, count(*) AS n, count(*) FILTER (sub) AS ns, count(*) FILTER (NOT sub) AS nn FROM o GROUP BY 1),
e AS (SELECT s, k, {pick_sql(("added", None), 'k')} AS kind FROM o WHERE k % 3 = 0), en AS (SELECT s, count(*) AS n FROM e GROUP BY 1),
h AS (SELECT *, contains(b || chr(10) || a, '甲方')::INT + contains(b || chr(10) || a, '付款')::INT + contains(b || chr(10) || a, '合同')::INT AS hits
  FROM o WHERE k % 2 = 0),
c AS (SELECT e.s, count(DISTINCT e.k) AS n FROM e JOIN h ON e.s = h.s AND (e.kind IS NULL OR e.kind = h.kind) AND h.hits / 3 >= 0.6 GROUP BY 1),
r AS (SELECT s, k, b || chr(10) || a AS t, {pick_sql(("d", "", None), 'k')} AS src, k % 7 < 4 AS ok FROM o WHERE k % 2 = 1), rn AS (SELECT s,
  count(*) AS n, count(*) FILTER (ok) AS nv, count(*) FILTER (src <> '') AS nt FROM r GROUP BY 1),
p AS (SELECT r.s, count(DISTINCT r.k) AS n FROM r JOIN o ON r.s = o.s AND NOT o.sub AND (contains(r.t, o.b) OR contains(r.t, o.a)) GROUP BY 1)
SELECT c_custkey AS sample_id, coalesce(d.n, 0) AS candidate_diff_count, coalesce(ns, 0) AS substantive_diff_count, round(coalesce(coalesce(c.n,
  0) / nullif(en.n, 0), 1.0), 6) AS expected_diff_coverage,
 round(1 - coalesce(coalesce(p.n, 0) / nullif(nn, 0), 0.0), 6) AS move_noop_filter_accuracy, round(coalesce(coalesce(rn.n, 0) / nullif(ns, 0), 0.0),
  6) AS diff_to_rule_conversion_rate, round(coalesce(nv / nullif(rn.n, 0), 0.0), 6) AS trace_validated_rate, round(coalesce(nt / nullif(rn.n, 0), 0.0),
  6) AS trace_diff_id_present_rate
FROM customer LEFT JOIN d ON c_custkey = d.s LEFT JOIN en ON c_custkey = en.s LEFT JOIN c ON c_custkey = c.s LEFT JOIN rn ON c_custkey = rn.s LEFT
  JOIN p ON c_custkey = p.s"""


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for a whole run: rates over answers (orders), items (line items), expectations (customers), and stability (events)."""
    all_ = F.lit("all").alias("all")
    k = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select(all_, (k % 9 != 0).alias("schema_pass"), (k % 4 != 0).alias("counts_agree"), pick(("a", "b", None), k).alias("predicted_type"), pick(("a", "b"), k).alias("expected_type"), (k % 6).alias("n_output"), (k % 5).alias("n_rules"))
    l = F.col("l_partkey")
    items = table(spark, sf_dir, "lineitem").select(all_, pick(("pass", "high", "medium", "low"), l).alias("risk"), pick(("通过", "高风险", "低风险"), l).alias("risk_label"), pick(("R", " ", None), l).alias("rule_code"), pick(("standard", "risky"), l).alias("quality_bucket"))
    c = F.col("c_custkey")
    item = F.when(c % 5 != 0, F.struct(pick(("pass", "high"), c).alias("risk"), pick(("replace", "manual"), c).alias("action_type"), pick(("付款期限", "其他"), c).alias("key"), pick((evaluate.MISSING_ZH, "甲方付款", "无"), c).alias("content"), pick(("建议明确", "复核"), c).alias("advice"), pick(("无", "30日", "补充"), c).alias("replace_text")))
    found = table(spark, sf_dir, "customer").select(
        all_, item.alias("item"), pick(("pass", "low"), c).alias("risk_gold"), F.lit("replace").alias("action_type_gold"), F.array(F.lit("付款")).alias("key_aliases"), pick(("missing_clause", "quote", "none"), c).alias("content_mode"), F.lit("付款").alias("content_anchor"), F.lit("明确").alias("advice_expectation"), (c % 2 == 0).alias("must_not_invent_numbers"),
    )
    runs = evaluate.run_stability(table(spark, sf_dir, "events").withColumn("all", F.lit("all")), "user_id", "event_id", ["event_type"], ["all"])
    return scoring.audit_summary(evaluate.record_rates(records, ["all"]), evaluate.item_rates(items, ["all"]), evaluate.expectation_rates(found, ["all"]), runs).drop("n", "false_negative_rate")


AUDIT_SQL = f"""WITH r AS (SELECT o_orderkey AS k FROM orders), rr AS (SELECT round(count(*) FILTER (k % 9 <> 0) / count(*), 6) AS schema_pass_rate,
  round(count(*) FILTER (k % 4 <> 0) / count(*), 6) AS count_alignment_rate,
 round(count(*) FILTER ({pick_sql(("a", "b", None), 'k')} = {pick_sql(("a", "b"), 'k')}) / count({pick_sql(("a", "b", None), 'k')}),
  6) AS type_accuracy, round(sum(least(k % 6, k % 5)) / sum(k % 5), 6) AS retention_rate FROM r),
i AS (SELECT l_partkey AS k FROM lineitem),
  ii AS (SELECT round(count(*) FILTER ({pick_sql(("通过", "高风险", "中风险", "低风险"), 'k')} = {pick_sql(("通过", "高风险", "低风险"), 'k')}) / count(*),
  6) AS label_consistency_rate, round(count(*) FILTER (k % 3 = 0) / count(*), 6) AS code_fill_rate,
 round(count(*) FILTER (k % 2 = 0 AND k % 4 <> 0) / count(*) FILTER (k % 2 = 0), 6) AS false_positive_rate FROM i),
c AS (SELECT c_custkey AS k, c_custkey % 5 <> 0 AS there, c_custkey % 2 AS two, c_custkey % 3 AS three FROM customer),
  cc AS (SELECT count(*) FILTER (there) AS n_found, round(1.0::DOUBLE * count(*) FILTER (there AND two = 0) / count(*) FILTER (there),
  6) AS risk_accuracy,
 round(count(*) FILTER (there AND two = 0) / count(*) FILTER (there), 6) AS action_type_accuracy, round(count(*) FILTER (there
  AND two = 0) / count(*), 6) AS key_hit_rate, round(count(*) FILTER (there) / count(*), 6) AS content_quote_accuracy,
 round(count(*) FILTER (there AND three = 0) / count(*) FILTER (three = 0), 6) AS missing_clause_accuracy, round(count(*) FILTER (there
  AND two = 0) / count(*) FILTER (there), 6) AS advice_alignment_rate, round(count(*) FILTER (there AND two = 0
  AND three <> 1) / count(*) FILTER (there AND two = 0), 6) AS non_fabrication_rate FROM c),
e AS (SELECT round(count(*) FILTER (n > 1 AND event_type IS NOT DISTINCT FROM f) / count(*) FILTER (n > 1), 6) AS event_type_stability
  FROM (SELECT event_type, row_number() OVER w AS n, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id
  ORDER BY event_id)))
SELECT * FROM rr, ii, cc, e"""


def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reports as one, with what each lacks."""
    o, c, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    merged = scoring.merge_reports(o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))
    return merged.groupBy("report", "nation").agg(F.count(F.lit(1)).alias("n_rows"), F.count("score").alias("n_scored"))


MERGED_SQL = "SELECT 0 AS report, NULL::INTEGER AS nation, count(*) AS n_rows, count(o_totalprice) AS n_scored FROM orders UNION ALL SELECT 1, c_nationkey, count(*), 0 FROM customer GROUP BY c_nationkey UNION ALL SELECT 2, s_nationkey, count(*), 0 FROM supplier GROUP BY s_nationkey"


def expanded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as samples whose text is put together."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.array(F.col("p_name")).alias("parts"), F.array(F.lit("x"), F.lit("y")).alias("repeat"), (k % 4).alias("repeat_count"), F.when(k % 2 == 0, F.array(F.lit("end"))).alias("suffix")).alias("text"))
    return p.select("p_partkey", scoring.expanded(F.col("text")).alias("text"))


EXPANDED_SQL = "SELECT p_partkey, p_name || repeat(chr(10) || 'x' || chr(10) || 'y', (p_partkey % 4)::INT) || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'end' ELSE '' END AS text FROM part"

QUERIES = {f.__name__: f for f in (weighted_scores, form_checks, compare_case_counts, compare_summary, stub_run, trace_diagnostics, audit_summary, merged_reports, expanded_texts)}
ORACLES = {
    "weighted_scores": WEIGHTED_SQL, "form_checks": FORM_SQL, "compare_case_counts": COMPARE_COUNTS_SQL, "compare_summary": COMPARE_SUMMARY_SQL, "stub_run": STUB_SQL, "trace_diagnostics": TRACE_SQL,
    "audit_summary": AUDIT_SQL, "merged_reports": MERGED_SQL, "expanded_texts": EXPANDED_SQL,
}
