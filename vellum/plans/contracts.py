"""Queries over sample clauses chosen by the star schema's keys: labels of changes, mined rules, results of comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as T
from ..operators import answers, base_info, mine, retrieve
from .documents import table
from .phrases import PHRASES, any_sql, cascade_sql, in_sql, pick, pick_sql, quoted

_KINDS = ("added", "deleted", "modified", "moved", "unknown")
_ROLES = ("甲方", "委托方", "供应方", "收款方", "路人", "", None)
_TYPES = ("采购合同", "服务合同", None, "合作协议")


def _count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(name))


# --- labels ---------------------------------------------------------------------------------------


def change_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of a clause: module, category, risk and type, counted."""
    o = table(spark, sf_dir, "orders").select(pick(PHRASES, "o_orderkey").alias("before"), pick(PHRASES, "o_custkey").alias("after"), pick(_KINDS, "o_orderkey").alias("kind"))
    category = labels.diff_category(F.lit(""), F.col("before"), F.col("after"), F.col("kind"))
    return _count(o.select(labels.review_module(F.col("before"), F.col("after")).alias("review_module"), category.alias("category"), labels.diff_risk(category).alias("risk_level"), labels.change_type(F.col("kind")).alias("change_type")))


_MODULE = cascade_sql("t", labels.MODULES_ZH, f"CASE WHEN {any_sql('t', labels.BREACH_ZH)} THEN CASE WHEN contains(t, '上限') AND contains(t, '赔偿') THEN '赔偿责任上限' ELSE '违约责任' END ELSE '通用条款' END")
_CHANGES = f"ch AS (SELECT o_orderkey, o_custkey, {pick_sql(PHRASES, 'o_orderkey')} AS before, {pick_sql(PHRASES, 'o_custkey')} AS after, {pick_sql(_KINDS, 'o_orderkey')} AS kind FROM orders), ct AS (SELECT *, before || after AS t FROM ch), cm AS (SELECT *, {_MODULE} AS review_module FROM ct)"
CHANGE_LABELS_SQL = f"""WITH {_CHANGES}, c AS (SELECT review_module, CASE WHEN {in_sql('kind', labels.CHANGE_TYPES)} THEN kind
  ELSE 'modified' END AS change_type, {cascade_sql('t', labels.CATEGORIES_ZH, "CASE WHEN kind = 'moved' THEN '条款位置' ELSE '其他' END")} AS category
  FROM cm)
SELECT review_module, category, CASE WHEN {in_sql('category', labels.MEDIUM_ZH)} THEN 'medium' ELSE 'low' END AS risk_level, change_type,
  count(*) AS n_rows FROM c GROUP BY ALL"""

_NAMES = ("采购合同", "服务合同", "合作协议")
_TITLES = ("采购合同", "关于服务合同与采购合同", "补充合作协议", "备忘录", "")
_LEVELS = ("高", "中", "低", "high", "medium", "low", "?", "高风险", " MID ")
_MODULES = ("财务审查", "法律", "法务要点", "履行", "履约期限", "其它")
_FALLBACKS = ("财务", "其他", "没有", None)


def party_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as contracts: type, side, module of the rule and both normal forms of a risk, counted."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return _count(
        c.select(
            labels.earliest(pick(_TITLES, k), _NAMES, "其他").alias("contract_type"), labels.perspective(F.coalesce(pick(_ROLES, k), F.lit(""))).alias("side"),
            labels.rule_module(pick(_MODULES, k), pick(_FALLBACKS, k)).alias("module"), labels.compare_risk(pick(_LEVELS, k)).alias("compare_risk"), labels.final_risk(pick(_LEVELS, k)).alias("final_risk"),
        )
    )


_EARLIEST = "CASE WHEN " + in_sql("title", _NAMES) + " THEN title ELSE coalesce((SELECT n FROM (VALUES " + ", ".join(f"({quoted(n)}, {i})" for i, n in enumerate(_NAMES)) + ") v(n, i) WHERE contains(title, n) ORDER BY instr(title, n), i LIMIT 1), '其他') END"
_FINAL = "CASE " + " ".join(f"WHEN {in_sql('lv', words)} OR contains(lv, {quoted(name)}) THEN {quoted(risk)}" for risk, name, words in labels.RISKS) + " ELSE 'pass' END"
PARTY_LABELS_SQL = f"""WITH c AS (SELECT {pick_sql(_TITLES, 'c_custkey')} AS title, coalesce({pick_sql(_ROLES, 'c_custkey')}, '') AS role,
  {pick_sql(_MODULES, 'c_custkey')} AS m, {pick_sql(_FALLBACKS, 'c_custkey')} AS fb, {pick_sql(_LEVELS, 'c_custkey')} AS lv0 FROM customer),
d AS (SELECT *, replace(lower(trim(lv0)), ' ', '') AS lv FROM c)
SELECT {_EARLIEST} AS contract_type, CASE WHEN {in_sql('role', labels.ROLES_A)} THEN '甲方' WHEN {in_sql('role', labels.ROLES_B)} THEN '乙方' ELSE '通用' END AS side,
 CASE WHEN contains(m, '财务') THEN '财务' WHEN contains(m, '法务') OR contains(m, '法律') THEN '法务' WHEN contains(m, '履约') OR contains(m, '履行') THEN '履约'
  WHEN fb IN ('财务', '法务', '履约', '其他') THEN fb ELSE '其他' END AS module,
 CASE lv0 WHEN '高' THEN 'high' WHEN '中' THEN 'medium' WHEN '低' THEN 'low' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium'
  ELSE 'low' END AS compare_risk, {_FINAL} AS final_risk, count(*) AS n_rows FROM d GROUP BY ALL"""

_LINES = ("第三条 付款", "第12章 总则", "一、标的", "2.范围", "《总则》", "保密", "甲方应按期付款。", "x", "", "（1）内容", "违约")
_STYLES = ("Heading 1", "标题 2", "heading3", "Normal", None)


def heading_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as lines of a contract: kind and level by the line's form, and level by its style."""
    s = table(spark, sf_dir, "supplier")
    line = pick(_LINES, "s_suppkey")
    h = labels.heading(line)
    return _count(s.select(line.alias("line"), h["type"].alias("kind"), h["level"].alias("level"), labels.style_heading(pick(_STYLES, "s_suppkey")).alias("style_level"), labels.has_any(line, labels.KEY_CLAUSE_ZH).alias("is_key")))


HEADING_SQL = f"""WITH l AS (SELECT {pick_sql(_LINES, 's_suppkey')} AS line, lower(coalesce({pick_sql(_STYLES, 's_suppkey')}, '')) AS style FROM supplier),
k AS (SELECT *, CASE WHEN length(trim(line)) > 200 OR length(trim(line)) < 2 THEN 'body' WHEN regexp_matches(line,
  '^第[一二三四五六七八九十百千零0-9]+[条章节款项]') THEN 'heading2'
 WHEN regexp_matches(line, '^[一二三四五六七八九十百千零0-9]+[、.。]') THEN 'heading3' WHEN regexp_matches(line, '^[《『「]?[一-龥]{{2,20}}[》』」]?$') THEN 'heading1'
  ELSE 'body' END AS kind FROM l)
SELECT line, kind, CASE kind WHEN 'heading1' THEN 1 WHEN 'heading2' THEN 2 WHEN 'heading3' THEN 3 ELSE 0 END AS level,
 CASE WHEN regexp_matches(style, 'heading\\s*1|标题\\s*1') THEN 1 WHEN regexp_matches(style, 'heading\\s*2|标题\\s*2') THEN 2 WHEN regexp_matches(style,
  'heading\\s*3|标题\\s*3') THEN 3 END AS style_level,
 {any_sql('line', labels.KEY_CLAUSE_ZH)} AS is_key, count(*) AS n_rows FROM k GROUP BY ALL"""


# --- mined rules ----------------------------------------------------------------------------------


def _mining(spark, sf_dir):
    """Orders as differences, customers as pairs, nations as what retrieval gave to every pair of its number."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("diff_id"), F.col("o_orderkey").alias("n"), pick(PHRASES, "o_orderkey").alias("before"), pick(PHRASES, "o_custkey").alias("after"), (F.col("o_orderkey") % 3 != 0).alias("is_substantive"))
    diffs = o.withColumn("review_module", labels.review_module(F.col("before"), F.col("after")))
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pair_id"), pick(_TYPES, "c_custkey").alias("contract_type"), pick(_ROLES, "c_custkey").alias("review_role"), F.col("c_nationkey").alias("nation"))
    modules = ("违约责任", "赔偿责任上限", "付款条款", "合同标的", "所有权/风险转移")
    n = F.col("n_nationkey")
    cases = table(spark, sf_dir, "nation").select(
        n.alias("nation"), n.alias("pos"), pick(modules, n).alias("review_module"), F.col("n_name").alias("risk_name"), F.lit("查").alias("check_point"), F.lit("当").alias("trigger_condition"), F.lit("议").alias("suggestion_template"),
        pick(("例", ""), n).alias("example_clause"), pick(("高", None), n).alias("default_risk_level"), F.lit("意").alias("user_intent"), F.array(pick(("服务合同", ""), n)).alias("contract_type"),
    )
    return diffs, pairs, pairs.select("pair_id", "nation").join(cases, "nation")


def mined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rules without a model, counted by what they say."""
    found = mine.stub_candidates(*_mining(spark, sf_dir))
    return found.groupBy("review_module", "contract_type", "review_perspective", "risk_name", "default_risk_level", "confidence", "user_intent").agg(
        F.count(F.lit(1)).alias("n_rules"), F.countDistinct("trigger_condition").alias("n_triggers"), F.max("trigger_condition").alias("last_trigger"), F.max("check_point").alias("check_point"),
        F.min("suggestion_template").alias("suggestion_template"), F.max("evidence_before").alias("last_before"), F.min("evidence_after").alias("first_after"), F.max("example_clause").alias("last_example"),
    )


_T = mine.TEMPLATES_ZH
_BY_MODULE = lambda i, end="": "CASE review_module " + " ".join(f"WHEN {quoted(m)} THEN {quoted(t[i])}{end}" for m, t in _T.items())
_CASE_MODULES = ("违约责任", "赔偿责任上限", "付款条款", "合同标的", "所有权/风险转移")
_SIDE = f"CASE WHEN {in_sql('role', labels.ROLES_A)} THEN '甲方' WHEN {in_sql('role', labels.ROLES_B)} THEN '乙方' ELSE '通用' END"
_MINED = f"""{_CHANGES}, pr AS (SELECT c_custkey, c_nationkey, {pick_sql(_TYPES, 'c_custkey')} AS ptype, coalesce({pick_sql(_ROLES, 'c_custkey')},
  '') AS role FROM customer),
cs AS (SELECT {pick_sql(_CASE_MODULES, 'n_nationkey')} AS m, n_nationkey AS k, n_name FROM nation),
d0 AS (SELECT cm.*, pr.ptype, pr.role, cs.n_name AS c_name, cs.k AS ck FROM cm JOIN pr ON cm.o_custkey = pr.c_custkey LEFT
  JOIN cs ON cs.k = pr.c_nationkey AND cs.m = review_module WHERE o_orderkey % 3 <> 0),
d AS (SELECT *, c_name IS NOT NULL AND NOT {in_sql('review_module', _T)} AS cased, CASE WHEN after <> '' THEN after ELSE before END AS ev FROM d0),
r AS (SELECT review_module, o_orderkey, coalesce(ptype, CASE WHEN cased AND ck % 2 = 0 THEN '服务合同' END, '通用合同') AS contract_type, {_SIDE} AS review_perspective,
 CASE WHEN cased THEN c_name ELSE {_BY_MODULE(0)} ELSE review_module || CASE WHEN suffix(review_module, '条款') THEN '约定不明确' ELSE '安排不当' END END END AS risk_name,
 CASE WHEN cased THEN '查' ELSE {_BY_MODULE(1)} ELSE '检查' || review_module || '是否存在与本次修改相同或类似的风险安排。' END END AS check_point,
 CASE WHEN cased THEN '当' ELSE {_BY_MODULE(2, ' || ev')} ELSE review_module || '条款出现类似修改前表述，可能影响权利义务、责任承担或履约确定性时触发。' END END AS trigger_condition,
 CASE WHEN cased THEN '议' ELSE {_BY_MODULE(3)} ELSE '建议参考本次修改后的表达，明确' || review_module || '中的关键条件、责任边界和履行要求。' END END AS suggestion_template,
 CASE WHEN cased AND ck % 2 = 0 THEN '高' ELSE '中' END AS default_risk_level, CASE WHEN cased THEN 0.78::DOUBLE ELSE 0.52::DOUBLE END AS confidence,
 CASE WHEN cased THEN '意' ELSE {quoted(mine.NO_CASE_INTENT_ZH)} END AS user_intent, CASE WHEN cased THEN CASE WHEN ck % 2 = 0 THEN '例' ELSE before END
  WHEN before <> '' THEN before ELSE after END AS example_clause,
 CASE WHEN cased OR before <> '' THEN before ELSE '原合同未约定对应内容' END AS eb, CASE WHEN cased OR after <> '' THEN after ELSE '修改后未保留对应内容' END AS ea FROM d)"""
MINED_SQL = f"""WITH {_MINED} SELECT review_module, contract_type, review_perspective, risk_name, default_risk_level, confidence, user_intent,
  count(*) AS n_rules, count(DISTINCT trigger_condition) AS n_triggers, max(trigger_condition) AS last_trigger,
 max(check_point) AS check_point, min(suggestion_template) AS suggestion_template, max(eb) AS last_before, min(ea) AS first_after,
  max(example_clause) AS last_example FROM r GROUP BY ALL"""

_DECISIONS = ("included", "ignored", None)


def _candidates(spark, sf_dir):
    """Orders as candidates of their customer's task."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    words = {c: F.lit(c) for c in ("contract_type", "check_point", "trigger_condition", "default_risk_level", "suggestion_template", "example_clause", "review_perspective")}
    return o.select(k.alias("candidate_id"), F.col("o_custkey").alias("task_id"), pick(tuple(_T)[:5], k).alias("review_module"), F.col("o_orderstatus").alias("risk_name"), pick(_DECISIONS, F.col("o_custkey") + k).alias("decision"), (k % 4).alias("source_pair_index"), *[c.alias(n) for n, c in words.items()])


def candidate_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other candidate is to be imported: rows made, left out and stamped, by task's priority and module."""
    c = _candidates(spark, sf_dir)
    asked = c.where("candidate_id % 2 = 0").select("task_id", "candidate_id")
    records, left, stamped = mine.import_candidates(c, asked, F.lit("2024-01-01").cast("timestamp_ntz"))
    module = lambda df, name, *more: df.groupBy("review_module").agg(F.count(F.lit(1)).alias(name), *more)
    codes = F.count_if(F.col("rule_code").rlike("^RULE-[A-Z]+-[0-9A-F]{8}$") & F.col("enabled")).alias("n_coded"), F.min(F.substring("rule_code", 1, 8)).alias("prefix")
    return module(records, "n_imported", *codes).join(module(left, "n_left"), "review_module", "full").join(module(stamped.where("imported_rule_id IS NOT NULL"), "n_stamped"), "review_module", "full")


_CAND = f"ca AS (SELECT o_orderkey AS id, o_custkey, {pick_sql(tuple(_T)[:5], 'o_orderkey')} AS review_module, {pick_sql(_DECISIONS, 'o_custkey + o_orderkey')} AS decision, o_orderkey % 4 AS pair FROM orders)"
CANDIDATE_IMPORT_SQL = f"""WITH {_CAND}, a AS (SELECT * FROM ca WHERE id % 2 = 0)
SELECT review_module, count(*) FILTER (decision = 'included') AS n_imported, count(*) FILTER (decision = 'included') AS n_coded,
  'RULE-' || substring(CASE review_module WHEN '付款条款' THEN 'PAY' ELSE 'GEN' END, 1, 3) AS prefix,
 count(*) FILTER (decision IS DISTINCT FROM 'included') AS n_left, count(*) FILTER (decision = 'included') AS n_stamped FROM a GROUP BY ALL"""


def candidate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.decision_counts(_candidates(spark, sf_dir))


DECISIONS_SQL = f"WITH {_CAND} SELECT o_custkey AS task_id, count(*) FILTER (decision = 'included') AS included, count(*) FILTER (decision = 'ignored') AS ignored, count(*) FILTER (coalesce(decision, 'pending') = 'pending') AS pending, count(DISTINCT pair) AS pair_count FROM ca GROUP BY 1"


def coerced_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rules that a model gave, with fields lacking here and there, in normal form."""
    diffs, pairs, _ = _mining(spark, sf_dir)
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")  # noqa: E741
    k = F.col("l_partkey")
    raw = l.select(
        F.col("o_custkey").alias("pair_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rule_id"), pick(("a", None), k).alias("risk_name"), pick(("b", "c", None), k).alias("rule_name"),
        F.when(k % 4 == 0, F.array(F.lit("采购合同"), F.lit("x"))).when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, F.array(F.lit("服务合同"))).alias("contract_type"),
        pick((None, "乙方", ""), k).alias("review_perspective"), pick(("甲方", None), k).alias("review_role"), pick(("付款条款", "违约责任", "通用条款"), k).alias("review_module"),
        pick(("高", None), k).alias("default_risk_level"), (k % 2).cast("int").alias("n_traces"),
    )
    out = mine.coerced(raw, pairs, diffs)
    return out.groupBy("review_module", "risk_name", "contract_type", "review_perspective", "default_risk_level", "n_traces", "confidence").agg(F.count(F.lit(1)).alias("n_rules"), F.sum("source_diff_id").alias("diff_ids"))


COERCED_SQL = f"""WITH {_CHANGES}, pr AS (SELECT c_custkey, {pick_sql(_TYPES, 'c_custkey')} AS ptype, {pick_sql(_ROLES, 'c_custkey')} AS prole FROM customer),
w AS (SELECT o_custkey AS pair_id, l_orderkey, l_partkey AS k, {pick_sql(("付款条款", "违约责任", "通用条款"), 'l_partkey')} AS review_module,
  coalesce({pick_sql(("a", None), 'l_partkey')}, {pick_sql(("b", "c", None), 'l_partkey')}) AS risk_name,
 nullif({pick_sql((None, "乙方", ""), 'l_partkey')}, '') AS pv, {pick_sql(("甲方", None), 'l_partkey')} AS rl,
  coalesce({pick_sql(("高", None), 'l_partkey')}, '中') AS default_risk_level FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT o_custkey, review_module AS m, o_orderkey FROM cm WHERE o_orderkey % 3 <> 0), f AS (SELECT o_custkey, min(o_orderkey) AS any_diff FROM s
  GROUP BY 1), fm AS (SELECT o_custkey, m, min(o_orderkey) AS own FROM s GROUP BY ALL),
x AS (SELECT w.*, coalesce(pv, rl, prole, '') AS role, CASE k % 4 WHEN 0 THEN '采购合同' WHEN 1 THEN '通用合同' WHEN 2 THEN '服务合同' ELSE coalesce(ptype,
  '通用合同') END AS contract_type,
 CASE WHEN k % 2 = 0 THEN coalesce(fm.own, f.any_diff) END AS src FROM w LEFT JOIN pr ON pair_id = c_custkey LEFT JOIN f ON pair_id = f.o_custkey LEFT
  JOIN fm ON pair_id = fm.o_custkey AND w.review_module = fm.m)
SELECT review_module, risk_name, contract_type, {_SIDE} AS review_perspective, default_risk_level, (k % 2)::INTEGER AS n_traces, CASE
  WHEN src IS NOT NULL THEN 0.72::DOUBLE END AS confidence, count(*) AS n_rules, sum(src)::BIGINT AS diff_ids FROM x GROUP BY ALL"""


def context_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each difference's context is searched by, counted."""
    diffs, _, _ = _mining(spark, sf_dir)
    return _count(diffs.select(mine.context_query(F.col("review_module"), F.col("before"), F.col("after")).alias("query")))


_MORE = "CASE review_module " + " ".join(f"WHEN {quoted(m)} THEN ' ' || {quoted(w)}" for m, w in mine.CONTEXT_ZH.items()) + " ELSE '' END"
CONTEXT_QUERIES_SQL = f"WITH {_CHANGES} SELECT review_module || ' ' || before || ' ' || after || {_MORE} AS query, count(*) AS n_rows FROM cm GROUP BY ALL"


def change_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes are about, in words, counted."""
    o = table(spark, sf_dir, "orders").select(base_info.change_direction(pick(PHRASES, "o_orderkey"), pick(PHRASES, "o_custkey")).alias("direction"))
    return _count(o)


_NUMBERS = lambda c: f"list_transform(regexp_extract_all({c}, '[0-9]+\\s*(?:日|天|年|个月|月|%|％)?'), lambda x: regexp_replace(x, '\\s', '', 'g'))"
_NUMBER = f"CASE WHEN len({_NUMBERS('before')}) > 0 AND len({_NUMBERS('after')}) > 0 AND {_NUMBERS('before')} <> {_NUMBERS('after')} THEN {_NUMBERS('before')}[1] || '改' || {_NUMBERS('after')}[1] END"
_DIRECTION = (
    "CASE " + " ".join(f"WHEN {any_sql('t', words)} THEN {quoted(name)}" + (" || coalesce(' ' || num, '')" if numbered else "") for name, words, numbered in base_info.CHANGES_ZH)
    + " WHEN num IS NOT NULL THEN num " + " ".join(f"WHEN contains(before, {quoted(x)}) AND contains(after, {quoted(y)}) THEN {quoted(name)}" for name, x, y in base_info.TURNS_ZH)
    + f" WHEN contains(t, {quoted(base_info.SECRECY_ZH[1])}) AND contains(t, {quoted(base_info.SECRECY_ZH[2])}) THEN {quoted(base_info.SECRECY_ZH[0])} WHEN {any_sql('t', base_info.DISPUTE_ZH[1])} THEN {quoted(base_info.DISPUTE_ZH[0])} ELSE {quoted(base_info.CHANGED_ZH)} END"
)
_DIRECTED = f"{_CHANGES}, nu AS (SELECT *, {_NUMBER} AS num FROM cm), di AS (SELECT *, {_DIRECTION} AS direction FROM nu)"
DIRECTIONS_SQL = f"WITH {_DIRECTED} SELECT direction, count(*) AS n_rows FROM di GROUP BY ALL"


def case_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pair's modules are looked up by."""
    diffs, pairs, _ = _mining(spark, sf_dir)
    return mine.case_queries(diffs, pairs)


CASE_QUERIES_SQL = f"""WITH {_DIRECTED}, f AS (SELECT o_custkey, review_module, direction, min(o_orderkey) AS n FROM di WHERE o_orderkey % 3 <> 0
  GROUP BY ALL), l AS (SELECT o_custkey, review_module, string_agg(direction, '；' ORDER BY n) AS d FROM f GROUP BY ALL)
SELECT o_custkey AS pair_id, review_module, coalesce({pick_sql(_TYPES, 'o_custkey')},
  '通用合同') || ' ' || coalesce(nullif({pick_sql(_ROLES, 'o_custkey')}, ''), '通用角色') || ' ' || review_module || ' ' || d || ' 逆向生成审核规则' AS query FROM l"""

_ASKED = ("付款 条款", "仅措辞 润色", "格式变化", "未 发生 实质 变化", "", None, "标点 变化吗")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as queries; those about wording alone are not looked up."""
    q = table(spark, sf_dir, "part").select(pick(_ASKED, "p_partkey").alias("query"))
    return _count(retrieve.worth_a_search(q))


SEARCHES_SQL = f"WITH q AS (SELECT {pick_sql(_ASKED, 'p_partkey')} AS query FROM part) SELECT query, count(*) AS n_rows FROM q WHERE NOT coalesce({any_sql("replace(query, ' ', '')", retrieve.WORDING_ZH)}, false) GROUP BY 1"


# --- results of comparisons -----------------------------------------------------------------------


def comparison_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results in either form; what each comes to, counted."""
    k, kind, level = F.col("o_orderkey"), pick(("新增", "DELETE", "修改", None), "o_orderkey"), pick(("高风险", "mid", "低", "通过", None), "o_custkey")
    old, new = pick(PHRASES, "o_orderkey"), pick(PHRASES, "o_custkey")
    q = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    item = F.concat(F.lit('{"type": '), q(kind), F.lit(', "rule_id": "R", "old": '), q(old), F.lit(', "new": '), q(new), F.lit(', "analysis": "A", "risk_level": '), q(level), F.lit("}"))
    listed = F.concat(F.lit('{"output": {"diff_list": ['), item, F.lit(', {"type": "added", "risk_level": "high"}], "stats": {"addCount": "2", "deleteCount": 1}, "summary": "S"}}'))
    whole = F.concat(F.lit('{"success": false, "total_risks": '), F.pmod(k, F.lit(7)).cast("string"), F.lit(', "message": "M", "enhanced": [{"original": '), q(new), F.lit(', "risk_level": "low"}]}'))
    r = table(spark, sf_dir, "orders").select(answers.normalized_comparison(F.when(k % 3 == 0, whole).otherwise(listed)).alias("r")).select("r.*")
    first = F.get("items", F.lit(0))
    return _count(r.select("success", "total_risks", "added", "deleted", "modified", "summary", F.size("items").alias("n_items"), *[first[c].alias(f"first_{c}") for c in ("original", "change_type", "category", "risk_level", "evidence", "impact", "suggestion")]))


COMPARISON_SQL = f"""WITH o AS (SELECT o_orderkey % 3 = 0 AS w, (o_orderkey % 7)::INTEGER AS total,
  {pick_sql(("新增", "DELETE", "修改", None), 'o_orderkey')} AS kind, {pick_sql(("高风险", "mid", "低", "通过", None), 'o_custkey')} AS lv,
  {pick_sql(PHRASES, 'o_orderkey')} AS old, {pick_sql(PHRASES, 'o_custkey')} AS new FROM orders),
l AS (SELECT *, CASE lv WHEN '高风险' THEN 'high' WHEN 'mid' THEN 'medium' ELSE 'low' END AS level FROM o)
SELECT NOT w AS success, CASE WHEN w THEN total ELSE 1 + (level <> 'low')::INTEGER END AS total_risks, CASE WHEN w THEN 0 ELSE 2 END AS added, CASE
  WHEN w THEN 0 ELSE 1 END AS deleted, 0 AS modified, CASE WHEN w THEN 'M' ELSE 'S' END AS summary, CASE WHEN w THEN 1 ELSE 2 END AS n_items,
 CASE WHEN w THEN new WHEN new <> '' THEN new WHEN old <> '' THEN old ELSE '->' END AS first_original, CASE WHEN w THEN NULL
  WHEN kind = '新增' THEN 'added' WHEN kind = 'DELETE' THEN 'deleted' ELSE 'modified' END AS first_change_type, CASE
  WHEN NOT w THEN 'R' END AS first_category,
 CASE WHEN w THEN 'low' ELSE level END AS first_risk_level, CASE WHEN NOT w THEN '旧版：' || old || chr(10) || '新版：' || new END AS first_evidence, CASE
  WHEN NOT w THEN 'A' END AS first_impact, CASE WHEN NOT w THEN '' END AS first_suggestion, count(*) AS n_rows FROM l GROUP BY ALL"""


def enhanced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as differences of their customer, met by place with what was answered for every other one."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    pos = k.alias("pos")
    diffs = o.select("o_custkey", pos, F.concat(F.lit("改"), pick(PHRASES, k)).alias("original"), pick(_KINDS, k).alias("change_type"), pick(PHRASES, k).alias("old_quote"), pick((*PHRASES[1:], None), "o_custkey").alias("new_quote"))
    said = o.where("o_orderkey % 4 = 1 OR o_orderkey % 8 = 2").select("o_custkey", pos, pick(("类", None), k).alias("category"), pick(("", "要"), k).alias("summary"), pick(_LEVELS, k).alias("risk_level"), pick((None, "证", ""), k).alias("evidence"), pick(("影", ""), k).alias("impact"), pick((None, "议"), k).alias("suggestion"))
    return _count(answers.fill_enhanced(diffs, said, ["o_custkey"]).drop("o_custkey", "pos"))


ENHANCED_SQL = f"""WITH d AS (SELECT '改' || {pick_sql(PHRASES, 'o_orderkey')} AS original, {pick_sql(_KINDS, 'o_orderkey')} AS kind,
  {pick_sql(PHRASES, 'o_orderkey')} AS o, coalesce({pick_sql((*PHRASES[1:], None), 'o_custkey')}, '') AS n, o_orderkey % 4 = 1
  OR o_orderkey % 8 = 2 AS a,
 {pick_sql(("类", None), 'o_orderkey')} AS c, {pick_sql(("", "要"), 'o_orderkey')} AS s, {pick_sql(_LEVELS, 'o_orderkey')} AS lv,
  {pick_sql((None, "证", ""), 'o_orderkey')} AS e, {pick_sql(("影", ""), 'o_orderkey')} AS i, {pick_sql((None, "议"), 'o_orderkey')} AS g FROM orders)
SELECT original, CASE WHEN {in_sql('kind', labels.CHANGE_TYPES)} THEN kind ELSE 'modified' END AS change_type, o AS old_quote, n AS new_quote, CASE
  WHEN a THEN coalesce(c, '') ELSE '' END AS category, CASE WHEN a AND s <> '' THEN s ELSE original END AS summary,
 CASE WHEN NOT a THEN 'low' ELSE CASE lv WHEN '高' THEN 'high' WHEN '中' THEN 'medium' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium'
  ELSE 'low' END END AS risk_level,
 CASE WHEN a AND e <> '' THEN e WHEN o <> '' AND n <> '' THEN '旧合同约定：' || o || '；新合同约定：' || n WHEN n <> '' THEN '新合同新增：' || n
  WHEN o <> '' THEN '旧合同删除：' || o ELSE '' END AS evidence,
 CASE WHEN a AND i <> '' THEN i ELSE {quoted(answers.IMPACT_ZH)} END AS impact, CASE WHEN a AND g <> '' THEN g
  ELSE {quoted(answers.SUGGESTION_ZH)} END AS suggestion, count(*) AS n_rows FROM d GROUP BY ALL"""


def default_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as differences without an answer, and as labelled text for a reader."""
    o = table(spark, sf_dir, "orders").select(F.lit("原").alias("original"), pick(_KINDS, "o_orderkey").alias("change_type"), pick(PHRASES, "o_orderkey").alias("old_quote"), pick(PHRASES, "o_custkey").alias("new_quote"))
    o = o.withColumn("told", answers.diff_text(F.col("change_type"), F.col("old_quote"), F.col("new_quote")))
    return _count(answers.default_item(o))


DEFAULT_ITEMS_SQL = f"""WITH {_CHANGES}, c AS (SELECT *,
  {cascade_sql("'原' || t", labels.CATEGORIES_ZH, "CASE WHEN kind = 'moved' THEN '条款位置' ELSE '其他' END")} AS category FROM cm)
SELECT '原' AS original, CASE WHEN {in_sql('kind', labels.CHANGE_TYPES)} THEN kind ELSE 'modified' END AS change_type, before AS old_quote, after AS new_quote,
 CASE kind WHEN 'modified' THEN '修改内容：' || before || ' → ' || after WHEN 'added' THEN '新增内容：' || after
  WHEN 'deleted' THEN '删除内容：' || before END AS told, category, CASE WHEN {in_sql('category', labels.MEDIUM_ZH)} THEN 'medium'
  ELSE 'low' END AS risk_level, '原' AS summary,
 CASE WHEN before <> '' AND after <> '' THEN '旧合同约定：' || before || '；新合同约定：' || after WHEN after <> '' THEN '新合同新增：' || after
  WHEN before <> '' THEN '旧合同删除：' || before ELSE '' END AS evidence, {quoted(answers.IMPACT_ZH)} AS impact,
  {quoted(answers.SUGGESTION_ZH)} AS suggestion, count(*) AS n_rows FROM c GROUP BY ALL"""

_SAID = ("Risk Level: high\nSummary: a b", "分类：付款\n- 建议： 复核 ", "Note\n  * Category :  x", "nothing", "Summary:\nCategory: y", "category: Z\nCategory: w")


def labelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as free answers; the values that labels tell."""
    said = pick(_SAID, "s_suppkey")
    v = lambda *names: answers.labelled_value(said, *names)
    return _count(table(spark, sf_dir, "supplier").select(said.alias("said"), v("Category", "分类").alias("category"), v("Summary", "摘要").alias("summary"), v("建议", "Suggestion").alias("suggestion"), v("Risk Level", "风险等级").alias("risk")))


def _value_sql(*names):
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(said, '(?i)(?:^|\\n)\\s*(?:[-*]\\s*)?{n}\\s*[:：]\\s*([^\\n]+)', 1)), '')" for n in names) + ", '')"


LABELLED_SQL = f"""WITH s AS (SELECT ([{', '.join("replace(" + quoted(x.replace(chr(10), '~')) + ", '~', chr(10))" for x in _SAID)}])[s_suppkey %
  {len(_SAID)} + 1] AS said FROM supplier)
SELECT said, {_value_sql("Category", "分类")} AS category, {_value_sql("Summary", "摘要")} AS summary, {_value_sql("建议", "Suggestion")} AS suggestion,
  {_value_sql("Risk Level", "风险等级")} AS risk, count(*) AS n_rows FROM s GROUP BY ALL"""


def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of each form; their files."""
    k = F.col("event_id").cast("string")
    shapes = F.array(
        F.concat(F.lit('{"message_type": "file", "message_id": "m", "file_key": "f'), k, F.lit('", "fileName": "a"}')),
        F.concat(F.lit('{"message_type": "file", "messageId": "n", "content": "{\\"fileKey\\": \\"g'), k, F.lit('\\", \\"name\\": \\"b\\"}"}')),
        F.lit('{"message_type": "text", "content": "{\\"file_key\\": \\"no\\"}"}'),
        F.concat(F.lit('{"message_type": "post", "message_id": "p", "content": "{\\"files\\": [{\\"file_key\\": \\"h'), k, F.lit('\\", \\"file_name\\": \\"c\\"}, {\\"name\\": \\"keyless\\"}, {\\"fileKey\\": \\"i\\"}]}"}')),
        F.concat(F.lit('{"message_type": "post", "message_id": "q", "content": "{\\"file_key\\": \\"j'), k, F.lit('\\"}"}')),
        F.lit('{"message_type": "file", "content": "no json"}'),
    )
    e = table(spark, sf_dir, "events").select("event_id", F.get(shapes, F.pmod("event_id", F.lit(6)).cast("int")).alias("message"))
    return answers.attachments(e).select("event_id", "message_id", "file_key", "file_name")


MESSAGE_FILES_SQL = """WITH e AS (SELECT event_id, event_id::VARCHAR AS k, event_id % 6 AS s FROM events)
SELECT event_id, 'm' AS message_id, 'f' || k AS file_key, 'a' AS file_name FROM e WHERE s = 0 UNION ALL SELECT event_id, 'n', 'g' || k, 'b' FROM e WHERE s = 1
UNION ALL SELECT event_id, 'p', 'h' || k, 'c' FROM e WHERE s = 3 UNION ALL SELECT event_id, 'p', 'i', NULL FROM e WHERE s = 3 UNION ALL
  SELECT event_id, 'q', 'j' || k, NULL FROM e WHERE s = 4"""


def failure_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules whose request failed, counted by what their items say."""
    k = F.col("p_partkey")
    rules = table(spark, sf_dir, "part").select(pick(("险", ""), k).alias("risk_name"), pick(("点", None, "查"), k).alias("check_point"), pick(("高", "通过", "", None, "低"), k).alias("default_risk_level"), pick((None, "议"), k).alias("suggestion_template"))
    return _count(answers.failure_items(rules, F.repeat(F.lit("超时"), 150)).select("risk", "key", F.length("tip").alias("tip_chars"), "content", "advice", "replace_text"))


FAILURE_SQL = f"""WITH p AS (SELECT {pick_sql(("险", ""), 'p_partkey')} AS n, {pick_sql(("点", None, "查"), 'p_partkey')} AS c,
  {pick_sql(("高", "通过", "", None, "低"), 'p_partkey')} AS lv, {pick_sql((None, "议"), 'p_partkey')} AS s FROM part),
r AS (SELECT *, CASE lv WHEN '高' THEN '高风险' WHEN '通过' THEN '通过' WHEN '低' THEN '低风险' ELSE '中风险' END AS risk FROM p)
SELECT risk, CASE WHEN n <> '' THEN n ELSE coalesce(c, '') END AS key, {len(answers.FAILED_ZH)} + 200 AS tip_chars, CASE WHEN risk = '通过' THEN '无'
  ELSE '未发现明确原文，但相关内容缺失' END AS content, coalesce(s, '建议人工复核相关条款。') AS advice, '无' AS replace_text, count(*) AS n_rows FROM r GROUP BY ALL"""


def clause_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of sample clauses as the comparison and the clause splitter cut them, their polished forms, and keywords."""
    from ..operators import segment

    s = table(spark, sf_dir, "supplier")
    text = F.concat(pick(("1. ", "第二条 ", "（3）", ""), "s_suppkey"), pick(PHRASES, "s_suppkey"), pick(("。", "；", "!"), "s_suppkey"), pick(PHRASES, F.col("s_suppkey") + 5))
    other = pick(PHRASES, F.col("s_suppkey") + 1)
    return _count(
        s.select(text.alias("text")).select(
            "text", F.array_join(T.clause_sentences(F.col("text")), "|").alias("clauses"), segment.polished(F.col("text")).alias("polished"), segment.aligned(F.col("text")).alias("aligned"),
            F.array_join(T.keywords(F.col("text")), "|").alias("keywords"), T.preview(F.col("text"), 9).alias("preview"), F.round(T.keyword_ratio(F.col("text"), F.array(F.lit("甲方"), F.lit("付款"), F.lit("SLA"))), 6).alias("ratio"),
            T.covers(F.col("text"), F.array(F.array(F.lit("甲方"), F.lit("乙方")), F.array(F.lit("付款"), F.lit("整改")))).alias("covered"),
        )
    )


_NUMBERED = r"^(?:\s*(?:第?[一二三四五六七八九十百]+[章节条款项、.)）]|[（(]?[0-9]+[).、）])\s*)+"
CLAUSE_TEXTS_SQL = f"""WITH s AS (SELECT {pick_sql(("1. ", "第二条 ", "（3）", ""), 's_suppkey')} || {pick_sql(PHRASES, 's_suppkey')} ||
  {pick_sql(("。", "；", "!"), 's_suppkey')} || {pick_sql(PHRASES, 's_suppkey + 5')} AS text FROM supplier),
p AS (SELECT text, translate(replace(replace(replace(replace(regexp_replace(trim(text), '{_NUMBERED}', ''), '应当', '应'), '按照', '按'), '服务费用', '服务费'),
  '相关服务', '服务'), '。，,. 、；;（）()', '') AS polished FROM s)
SELECT text, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[^。；;！？!?]+[。；;！？!?]?'), lambda x: trim(x)), lambda x: x <> ''),
  '|') AS clauses, polished, translate(polished, '：:', '') AS aligned,
 array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[，。！？；：、'' （）"]'), lambda x: trim(x)), lambda x: length(x) >= 2
  AND NOT ({in_sql('x', T.STOP_WORDS_ZH)}))[1:5], '|') AS keywords,
 CASE WHEN length(trim(text)) <= 9 THEN trim(text) ELSE left(trim(text), 9) || '...(truncated)' END AS preview, round((contains(text,
  '甲方')::INT + contains(text, '付款')::INT) / 3, 6) AS ratio,
 (contains(text, '甲方') OR contains(text, '乙方')) AND (contains(text, '付款') OR contains(text, '整改')) AS covered, count(*) AS n_rows FROM p GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (change_labels, party_labels, heading_labels, mined_rules, candidate_import, candidate_decisions, coerced_rules, context_queries, change_directions, case_queries, searches, comparison_results, enhanced_items, default_items, labelled_values, message_files, failure_items, clause_texts)}
ORACLES = {
    "change_labels": CHANGE_LABELS_SQL, "party_labels": PARTY_LABELS_SQL, "heading_labels": HEADING_SQL, "mined_rules": MINED_SQL, "candidate_import": CANDIDATE_IMPORT_SQL, "candidate_decisions": DECISIONS_SQL,
    "coerced_rules": COERCED_SQL, "context_queries": CONTEXT_QUERIES_SQL, "change_directions": DIRECTIONS_SQL, "case_queries": CASE_QUERIES_SQL, "searches": SEARCHES_SQL, "comparison_results": COMPARISON_SQL, "enhanced_items": ENHANCED_SQL, "default_items": DEFAULT_ITEMS_SQL,
    "labelled_values": LABELLED_SQL, "message_files": MESSAGE_FILES_SQL, "failure_items": FAILURE_SQL, "clause_texts": CLAUSE_TEXTS_SQL,
}
