"""Queries over the star schema in the place of tasks, risks, accounts and contracts: listings, look-ups, sets, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers, audit, base_info, link, mine, rules, segment, tables
from .documents import table
from .phrases import PHRASES, pick, pick_sql, quoted

def _tasks(spark, sf_dir):
    """Orders as tasks of their customer."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "processing").otherwise("completed")
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.pmod("o_orderkey", F.lit(100)).cast("int").alias("progress"), pick(("broken", None), "o_orderkey").alias("error_message"))


_TASKS = "t AS (SELECT o_orderkey AS task_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'processing' ELSE 'completed' END AS status, o_orderdate AS created_at, (o_orderkey % 100)::INTEGER AS progress, ['broken', NULL][o_orderkey % 2 + 1] AS error_message FROM orders)"


def task_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 3 of user 7's tasks, newest first, in a range of dates, with an unknown status; the page is the feature."""
    out = tables.listing(_tasks(spark, sf_dir), 7, "no such status", [F.desc("created_at"), F.desc("task_id")], 3, 3, since="1993-01-01", until="1998-12-31")
    return out.select("task_id", "status", "total")


TASK_LISTING_SQL = f"WITH {_TASKS}, r AS (SELECT * FROM t WHERE user_id = 7 AND created_at BETWEEN '1993-01-01' AND '1998-12-31') SELECT task_id, status, (SELECT count(*) FROM r) AS total FROM r ORDER BY created_at DESC, task_id DESC LIMIT 3 OFFSET 3"


def task_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other task is asked to start again; what tasks are like then, counted."""
    t = _tasks(spark, sf_dir)
    out = tables.retried(t, t.where("task_id % 2 = 0"))
    return out.groupBy("status", "accepted", (F.col("progress") == 0).alias("at_start"), F.col("error_message").isNull().alias("clean")).agg(F.count(F.lit(1)).alias("n_tasks"))


TASK_RETRIES_SQL = f"""WITH {_TASKS}, g AS (SELECT *, task_id % 2 = 0 AND status = 'failed' AS go FROM t)
SELECT CASE WHEN go THEN 'parsing' ELSE status END AS status, CASE WHEN task_id % 2 = 0 THEN go END AS accepted, CASE WHEN go THEN 0
  ELSE progress END = 0 AS at_start, go OR error_message IS NULL AS clean, count(*) AS n_tasks FROM g GROUP BY ALL"""


def versions_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as versions, newest first."""
    v = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version_no"))
    return tables.newest_first(v, "o_custkey")


VERSIONS_SQL = "SELECT o_custkey, o_orderkey AS version_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC)::INTEGER AS place FROM orders"


def risk_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as risks of reviews (orders) or comparisons (parts), with their sentence (suppliers) where there is one; counted by owner."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    review = F.col("l_linenumber") % 2 == 1
    risks = l.select(F.when(review, "review").otherwise("comparison").alias("kind"), F.when(review, F.col("l_orderkey")).otherwise(F.col("l_partkey")).alias("task_id"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_suppkey")).alias("sentence_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("user_id"))
    p = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("task_id"), F.col("p_size").cast("long").alias("user_id"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("sentence_id"), F.col("s_name").alias("sentence"))
    out = tables.owners(risks, {"review": o, "comparison": p}).join(s, "sentence_id", "left")
    return out.groupBy("kind", "owner").agg(F.count(F.lit(1)).alias("n_risks"), F.count("sentence").alias("n_sentences"))


RISK_OWNERS_SQL = """WITH r AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'review' ELSE 'comparison' END AS kind, CASE
  WHEN l_linenumber % 2 = 1 THEN l_orderkey ELSE l_partkey END AS task_id, CASE WHEN l_partkey % 3 <> 0 THEN l_suppkey END AS sentence_id
  FROM lineitem),
t AS (SELECT 'review' AS kind, o_orderkey AS task_id, o_custkey AS owner FROM orders UNION ALL SELECT 'comparison', p_partkey, p_size::BIGINT
  FROM part WHERE p_partkey % 5 <> 0)
SELECT kind, owner, count(*) AS n_risks, count(s_name) AS n_sentences FROM r LEFT JOIN t USING (kind, task_id) LEFT JOIN (SELECT * FROM supplier
  WHERE s_suppkey % 2 = 0) ON sentence_id = s_suppkey GROUP BY ALL"""


def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of each order as sets of ids: all, either once, common, lacking, whether equal or apart, and whether all are owned."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    a = l.select("l_orderkey", F.pmod("l_partkey", F.lit(9)).alias("id"))
    b = l.select("l_orderkey", F.pmod("l_suppkey", F.lit(9)).alias("id"))
    n = lambda df, name: df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias(name))
    owned = tables.all_owned(a, b, "l_orderkey", "id")
    out = n(a.unionByName(b), "n_all").join(n(a.union(b).distinct(), "n_union"), "l_orderkey").join(n(a.intersect(b), "n_common"), "l_orderkey", "left").join(n(a.exceptAll(a.intersect(b)).distinct().subtract(b), "n_lacking"), "l_orderkey", "left").join(owned, "l_orderkey")
    out = out.na.fill(0, ["n_common", "n_lacking"])
    return out.withColumn("equal", F.col("n_common") == F.col("n_union")).withColumn("apart", F.col("n_common") == 0)


ID_SETS_SQL = """WITH a AS (SELECT l_orderkey, l_partkey % 9 AS id FROM lineitem), b AS (SELECT l_orderkey, l_suppkey % 9 AS id FROM lineitem),
x AS (SELECT l_orderkey, list_distinct(list(id)) AS sa, count(*) AS na FROM a GROUP BY 1), y AS (SELECT l_orderkey, list_distinct(list(id)) AS sb,
  count(*) AS nb FROM b GROUP BY 1),
z AS (SELECT l_orderkey, na + nb AS n_all, len(list_distinct(list_concat(sa, sb))) AS n_union, len(list_intersect(sa, sb)) AS n_common,
  len(list_filter(sa, lambda i: NOT list_contains(sb, i))) AS n_lacking, len(sa) AS n_asked FROM x JOIN y USING (l_orderkey))
SELECT *, n_common AS n_owned, n_asked = n_common AS all_owned, n_common = n_union AS equal, n_common = 0 AS apart FROM z"""


def account_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as logins, orders' customers as users: tied by the first identity that fits, else given an id of their own."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    say = lambda name, n, test: F.when(test, F.concat(F.lit(name), n.cast("string")))
    logins = c.select(k.alias("login"), say("o", k, k % 7 == 0).alias("open_id"), say("u", k, k % 3 == 0).alias("union_id"), say("e", k, k % 2 == 0).alias("email"), say("p", k, k % 11 != 0).alias("mobile"))
    users = c.where("c_custkey % 4 <> 0").select((k * 10).alias("user_id"), say("o", k, k % 2 == 0).alias("open_id"), say("u", k + 3, F.lit(True)).alias("union_id"), say("e", k, k % 3 == 0).alias("email"), say("p", k, k % 5 < 3).alias("phone"))
    out = link.link_accounts(logins, users)
    made = link.account_id(F.col("open_id"), F.col("union_id"), F.col("email"), F.col("mobile"))
    return out.select("login", "user_id", F.when(F.col("user_id").isNull(), F.substring(made, 1, 8)).alias("new_id"))


ACCOUNTS_SQL = """WITH l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'o' || c_custkey END AS o, CASE
  WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey END AS u, CASE WHEN c_custkey % 2 = 0 THEN 'e' || c_custkey END AS e, CASE
  WHEN c_custkey % 11 <> 0 THEN 'p' || c_custkey END AS p FROM customer),
us AS (SELECT c_custkey * 10 AS id, CASE WHEN c_custkey % 2 = 0 THEN 'o' || c_custkey END AS o, 'u' || (c_custkey + 3) AS u, CASE
  WHEN c_custkey % 3 = 0 THEN 'e' || c_custkey END AS e, CASE WHEN c_custkey % 5 < 3 THEN 'p' || c_custkey END AS p FROM customer
  WHERE c_custkey % 4 <> 0),
j AS (SELECT k, coalesce(a.id, b.id, c.id, d.id) AS user_id, coalesce(l.o, l.u, l.e, l.p) AS first FROM l LEFT JOIN us a ON l.o = a.o LEFT
  JOIN us b ON l.u = b.u LEFT JOIN us c ON l.e = c.e LEFT JOIN us d ON l.p = d.p)
SELECT k AS login, user_id, CASE WHEN user_id IS NULL THEN left(sha256(first), 8) END AS new_id FROM j"""


def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a faulty rule file and of one without fault: errors, codes met before, codes that the catalogue has, rows to import."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(
        k.alias("row_number"), F.when(k % 13 != 0, F.concat(F.lit("C"), (k - k % 2 * (k % 3)).cast("string"))).alias("rule_code"), pick(("采购合同", " "), k).alias("contract_type"), F.lit("m").alias("review_module"), pick(("r", None, "s"), k).alias("risk_name"),
        F.lit("c").alias("check_point"), F.lit("t").alias("trigger_condition"), pick(("高", "很高", "", "低"), k).alias("default_risk_level"), F.lit("s").alias("suggestion_template"), pick(("甲方", "丙方", None), k).alias("review_perspective"),
    )
    known = p.where("p_partkey % 7 = 0").select(F.explode(F.array(F.concat(F.lit("C"), k.cast("string")), F.concat(F.lit("N"), k.cast("string")))).alias("rule_code"))
    fine = {"rule_code": F.concat(F.lit("N"), F.col("row_number")), "contract_type": F.lit("采购合同"), "risk_name": F.lit("r"), "default_risk_level": F.lit("高"), "review_perspective": F.lit("甲方")}

    def checked(file: str, of: DataFrame) -> DataFrame:
        out = rules.check_import(of, known)
        counts = out.groupBy(F.lit(file).alias("file"), F.array_join("errors", ",").alias("errors"), "exists").agg(F.count(F.lit(1)).alias("n_rows"))
        return counts.crossJoin(rules.importable(out).agg(F.count(F.lit(1)).alias("n_importable")))  # one row of one number

    return checked("faulty", rows).unionByName(checked("fine", rows.withColumns(fine)))


RULE_CHECKS_SQL = f"""WITH p AS (SELECT p_partkey AS k, CASE
  WHEN p_partkey % 13 <> 0 THEN 'C' || (p_partkey - p_partkey % 2 * (p_partkey % 3)) END AS code FROM part),
e AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY k) > 1 AND code IS NOT NULL AS again FROM p)
SELECT 'faulty' AS file, array_to_string(list_filter([CASE WHEN code IS NULL THEN 'rule_code is required' END, CASE WHEN k % 2 = 1 THEN 'contract_type is required' END,
  CASE WHEN k % 3 = 1 THEN 'risk_name is required' END,
 CASE WHEN k % 4 = 2 THEN 'default_risk_level is required' END, CASE WHEN k % 4 = 1 THEN 'default_risk_level is unknown' END, CASE
  WHEN k % 3 = 1 THEN 'review_perspective is unknown' END, CASE WHEN again THEN 'rule_code occurs twice' END], lambda x: x IS NOT NULL),
  ',') AS errors,
 code IN (SELECT 'C' || p_partkey FROM part WHERE p_partkey % 7 = 0) AND code IS NOT NULL AS exists, count(*) AS n_rows, 0::BIGINT AS n_importable
  FROM e GROUP BY ALL
UNION ALL SELECT 'fine', '', p_partkey % 7 = 0, count(*), (SELECT count(*) FROM part WHERE p_partkey % 7 <> 0) FROM part GROUP BY ALL"""


def rule_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules by brand and type's last word, one brand common to all."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("contract_type"), F.element_at(F.split("p_type", " "), -1).alias("review_module"))
    return rules.type_counts(p, "Brand#11")


RULE_TYPES_SQL = """WITH e AS (SELECT p_brand AS contract_type, string_split(p_type, ' ')[-1] AS review_module, count(*) AS n_module FROM part GROUP BY ALL)
SELECT *, sum(n_module) OVER w::BIGINT AS n_rules, count(*) OVER w AS n_modules, CASE WHEN contract_type = 'Brand#11' THEN 'common'
  ELSE 'specific' END AS scope FROM e WINDOW w AS (PARTITION BY contract_type)"""
RULE_TYPES_SQL = RULE_TYPES_SQL.replace("sum(n_module) OVER w::BIGINT", "(sum(n_module) OVER w)::BIGINT")


def rule_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as another service names their fields; a switch turns every third one off."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    r = p.select(k.cast("string").alias("rule_code"), F.col("p_brand").alias("contract_type"), F.col("p_type").alias("review_module"), F.col("p_name").alias("risk_name"), *[F.lit(c[0]).alias(c) for c in ("check_point", "trigger_condition", "default_risk_level", "suggestion_template", "example_clause", "review_perspective")], F.lit(True).alias("enabled"))
    off = p.where("p_partkey % 3 = 0").select(k.cast("string").alias("rule_code"), F.lit(False).alias("enabled"))
    on = tables.switched(r, off)
    return rules.service_fields(on.where("enabled"))


RULE_PROJECTION_SQL = "SELECT p_partkey::VARCHAR AS rule_id, p_brand AS contract_type, p_type AS module, p_name AS risk_name, 'c' AS check_point, 't' AS trigger_condition, 'd' AS default_risk_level, 's' AS suggestion_template, 'e' AS example_clause FROM part WHERE p_partkey % 3 <> 0"


def _contracts(spark, sf_dir):
    """Suppliers as contracts of seven lines with headers of both kinds."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    lines = [F.lit("第一条 总则"), pick(PHRASES, k), F.concat(F.lit("1. "), pick(PHRASES, k + 1), F.lit("。"), pick(PHRASES, k + 2)), F.lit("第二条 附则"), F.concat(F.lit("（2）"), pick(PHRASES, k + 3)), pick(PHRASES, k), F.lit("第一条 总则")]
    return s.select("s_suppkey", F.array_join(F.array(*lines), "\n").alias("text"))


def contract_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of each contract in the order in which they come."""
    seg = segment.clauses(_contracts(spark, sf_dir), "s_suppkey")
    return link.outline(seg, "s_suppkey")


_CLAUSES = f"""l AS (SELECT s_suppkey, unnest([1, 2, 3, 4, 5, 6, 7]) AS line, unnest(['总则', {pick_sql(PHRASES, 's_suppkey')},
  {pick_sql(PHRASES, 's_suppkey + 1')} || '。' || {pick_sql(PHRASES, 's_suppkey + 2')}, '附则', {pick_sql(PHRASES, 's_suppkey + 3')},
  {pick_sql(PHRASES, 's_suppkey')}, '总则']) AS body,
 unnest(['第一条', '第一条', '第一条 1', '第二条', '第二条 2', '第二条', '第一条']) AS title FROM supplier),
b AS (SELECT s_suppkey, line, title, list_filter(list_transform(regexp_extract_all(body, '[^。；;！？!?]+[。；;！？!?]?'), lambda x: trim(x)),
  lambda x: x <> '') AS parts FROM l),
u AS (SELECT s_suppkey, line, title, unnest(range(1, len(parts) + 1)) AS part, unnest(parts) AS text FROM b),
cl AS (SELECT s_suppkey, title, text, row_number() OVER (PARTITION BY s_suppkey ORDER BY line, part)::INTEGER AS "order" FROM u WHERE translate(text,
  '。，,. 、；;（）()：:', '') <> '')"""
OUTLINE_SQL = f"""WITH {_CLAUSES}, f AS (SELECT s_suppkey, title, min("order") AS "order" FROM cl GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY "order")::INTEGER AS place FROM f"""


def contract_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause sentences with ids and titles, and those around each second one."""
    seg = segment.clauses(_contracts(spark, sf_dir), "s_suppkey")
    near = link.neighbours(seg.select("s_suppkey", "order", "clause_id", "title", "text"), seg.where("order % 2 = 0").select("s_suppkey", "order"), "s_suppkey")
    return near.select("s_suppkey", "hit", "offset", "order", "clause_id", "title", "text")


CLAUSES_SQL = f"""WITH {_CLAUSES} SELECT h.s_suppkey, h."order" AS hit, (c."order" - h."order")::INTEGER AS offset, c."order", printf('s-%04d', c."order") AS clause_id, c.title, c.text FROM cl h JOIN cl c ON h.s_suppkey = c.s_suppkey AND abs(c."order" - h."order") <= 1 WHERE h."order" % 2 = 0"""


def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample clauses and parts of them, back to the clause of each contract that is equal, else holds or is held."""
    seg = segment.clauses(_contracts(spark, sf_dir), "s_suppkey")
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")).select("s_suppkey", (F.col("s_suppkey") * 10 + F.col("n")).alias("text_id"), F.substring(pick(PHRASES[:14], F.col("s_suppkey") + F.col("n")), 1, 30 - 5).alias("t"), "n")
    wanted = wanted.select("s_suppkey", "text_id", F.when(F.col("n") % 2 == 1, F.substring("t", 1, 4)).otherwise(F.col("t")).alias("wanted"))
    return link.segment_of(wanted, seg.select("s_suppkey", "order", "text"), "s_suppkey")


SEGMENT_SQL = f"""WITH {_CLAUSES}, w0 AS (SELECT s_suppkey, unnest(range(0, 6)) AS n FROM supplier), w1 AS (SELECT s_suppkey, n,
  s_suppkey * 10 + n AS text_id, left({pick_sql(PHRASES[:14], 's_suppkey + n')}, 25) AS t FROM w0),
w AS (SELECT s_suppkey, text_id, CASE WHEN n % 2 = 1 THEN left(t, 4) ELSE t END AS wanted FROM w1), j AS (SELECT w.s_suppkey, text_id, "order", CASE
  WHEN text = wanted THEN 0 WHEN contains(text, wanted) OR contains(wanted, text) THEN 1 END AS tier FROM w JOIN cl USING (s_suppkey)),
f AS (SELECT text_id, arg_min("order", tier * 1000 + "order") AS "order" FROM j WHERE tier IS NOT NULL GROUP BY 1) SELECT w.s_suppkey, w.text_id,
  wanted, f."order" FROM w LEFT JOIN f USING (text_id)"""


def reference_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that changes name, counted."""
    o = table(spark, sf_dir, "orders").select(link.reference_terms(F.concat(pick(PHRASES, "o_orderkey"), pick(("附件一", "", "上述", "定义"), "o_orderkey")), pick(PHRASES, "o_custkey")).alias("t"))
    return o.select(F.array_join("t", ",").alias("terms")).groupBy("terms").agg(F.count(F.lit(1)).alias("n_changes"))


def _terms_sql(terms):
    return "list_filter([" + ", ".join(f"CASE WHEN contains(x, {quoted(t)}) THEN {quoted(t)} END" for t in terms) + "], lambda y: y IS NOT NULL)"


REFERENCE_SQL = f"""WITH c AS (SELECT {pick_sql(PHRASES, 'o_orderkey')} || {pick_sql(("附件一", "", "上述", "定义"), 'o_orderkey')} ||
  {pick_sql(PHRASES, 'o_custkey')} AS x FROM orders), t AS (SELECT {_terms_sql(link.REFERENCES_ZH)} AS a, {_terms_sql(link.MORE_REFERENCES_ZH)} AS b
  FROM c)
SELECT array_to_string(CASE WHEN len(a) > 0 THEN a ELSE b END, ',') AS terms, count(*) AS n_changes FROM t GROUP BY ALL"""


def item_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an odd key as items of their customer, the others as differences: each item's first difference that holds a quote of it."""
    o, n = table(spark, sf_dir, "orders"), F.floor(F.col("o_orderkey") / 2)
    kind, side = pick(("added", "modified"), n), F.col("o_custkey").alias("pair_id")
    diffs = o.where("o_orderkey % 2 = 0").select(side, kind.alias("change_type"), F.col("o_orderkey").alias("diff_index"), pick((*PHRASES, None), n).alias("old_text"), pick(PHRASES, n + 3).alias("new_text"))
    items = o.where("o_orderkey % 2 = 1").select(side, kind.alias("change_type"), F.col("o_orderkey").alias("item_id"), F.substring(pick(PHRASES, n + 1), 1, 4).alias("old_quote"), F.substring(pick(PHRASES, n + 2), 3, 3).alias("new_quote"), F.lit("").alias("original"))
    return link.item_to_diff(items, diffs).select("item_id", "diff_index")


ITEM_DIFFS_SQL = f"""WITH n AS (SELECT *, o_orderkey // 2 AS n FROM orders), d AS (SELECT o_custkey, n % 2 AS kind, o_orderkey AS i,
  coalesce({pick_sql((*PHRASES, None), 'n')}, '') AS o, {pick_sql(PHRASES, 'n + 3')} AS w FROM n WHERE o_orderkey % 2 = 0),
t AS (SELECT o_custkey, n % 2 AS kind, o_orderkey AS id, left({pick_sql(PHRASES, 'n + 1')}, 4) AS oq, substring({pick_sql(PHRASES, 'n + 2')}, 3,
  3) AS nq FROM n WHERE o_orderkey % 2 = 1)
SELECT id AS item_id, min(i) FILTER ((oq <> '' AND contains(o, oq)) OR (nq <> '' AND contains(w, nq))) AS diff_index FROM t LEFT
  JOIN d USING (o_custkey, kind) GROUP BY id"""


def evidence_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as differences and as rules with traces: whether each rule's fields and evidence hold; and traces that fit just one difference."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    diffs = o.select(F.col("o_custkey").alias("pair_id"), k.alias("diff_id"), pick(PHRASES, k).alias("before"), pick(PHRASES, "o_custkey").alias("after"))
    trace = lambda id, b, a: F.struct(id.alias("source_diff_id"), b.alias("evidence_before"), a.alias("evidence_after"))
    b, a = F.substring(pick(PHRASES, k), 1, 4), F.substring(pick(PHRASES, "o_custkey"), 1, 4)
    traces = F.when(k % 5 == 0, F.array(trace(k, b, a)).cast("array<struct<source_diff_id:bigint,evidence_before:string,evidence_after:string>>")).when(k % 5 == 1, F.array(trace(k, b, a), trace(k + 1, b, a))).when(k % 5 == 2, F.array(trace(k, F.lit("不在"), a))).when(k % 5 == 3, F.array().cast("array<struct<source_diff_id:bigint,evidence_before:string,evidence_after:string>>")).otherwise(F.array(trace(k, b, a)))
    r = o.select(k.alias("rule_id"), k.alias("diff_id"), F.lit("r").alias("risk_name"), pick(("c", " "), F.floor(k / 5)).alias("check_point"), F.lit("t").alias("trigger_condition"), F.lit("s").alias("suggestion_template"), traces.alias("traces"))
    valid = mine.evidence_check(r, diffs).select("rule_id", "valid")
    asked = o.where("o_orderkey % 5 = 0").select(k.alias("trace_id"), F.col("o_custkey").alias("pair_id"), b.alias("evidence_before"), a.alias("evidence_after"))
    one = mine.unique_match(asked, diffs).select(F.col("trace_id").alias("rule_id"), "source_diff_id")
    return valid.join(one, "rule_id", "left")


EVIDENCE_VALID_SQL = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, {pick_sql(PHRASES, 'o_orderkey')} AS b,
  {pick_sql(PHRASES, 'o_custkey')} AS a FROM orders),
m AS (SELECT x.k, min(y.k) AS d FROM o x JOIN o y ON x.c = y.c AND contains(y.b, left(x.b, 4)) AND contains(y.a, left(x.a, 4)) WHERE x.k % 5 = 0
  GROUP BY x.k HAVING count(*) = 1)
SELECT o.k AS rule_id, k % 5 IN (0, 4) AND (k // 5) % 2 = 0 AND (left(b, 4) <> '' OR left(a, 4) <> '') AS valid, m.d AS source_diff_id FROM o LEFT
  JOIN m USING (k)"""


def answer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a service's answers: envelope, totals, counts, quotes, codes; counted."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"code": '), pick(("0", "7", "null"), k), F.lit(', "msg": "bad", "data": '), pick(('{"a": 1}', '"{\\"a\\": 2}"', "null"), F.floor(k / 3)), F.lit("}"))
    e = answers.envelope(body)
    total = pick(("3", "3.0", "-1", "true", "2.5", None, " 4 "), k)
    section = pick(("他说“甲方应付款”了", '"abc"', "未约定“甲方应付款”", 'x "long quote" y', ""), k)
    n = answers.diff_count(F.when(k % 6 == 0, k % 4).cast("int"), pick(("1", None), k), pick((None, "2"), k), pick(("x", "0"), k), pick(("5", ""), F.floor(k / 2)), pick(("6", None, "7"), k))
    o = table(spark, sf_dir, "orders").select(e["error"].alias("error"), F.get_json_object(e["data"], "$.a").alias("a"), answers.risk_total(total).alias("total"), answers.quote_in(section).alias("quote"), n.alias("n_diffs"), answers.rule_code(pick(("付款条款", "违约责任", "别的"), k), F.lit("x")).substr(1, 9).alias("code"))
    return o.groupBy(*o.columns).agg(F.count(F.lit(1)).alias("n_rows"))


ANSWER_SQL = f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey // 3 AS t FROM orders), p AS (SELECT k, CASE WHEN k % 3 = 1 THEN 'bad' END AS error,
  CASE t % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS a,
 CASE k % 7 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 6 THEN 4 END::BIGINT AS total, CASE k % 5 WHEN 0 THEN '甲方应付款' WHEN 3 THEN 'long quote'
  ELSE '未发现明确原文，但相关内容缺失' END AS quote,
 (CASE WHEN k % 6 = 0 THEN k % 4 ELSE CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END END)::INTEGER AS n_diffs, 'RULE-' || CASE k % 3 WHEN 0 THEN 'PAY-'
  WHEN 1 THEN 'BREA' ELSE 'GEN-' END AS code FROM o)
SELECT error, CASE WHEN error IS NULL THEN a END AS a, total, quote, n_diffs, code, count(*) AS n_rows FROM p GROUP BY ALL"""

_TEXTS = ("采购合同\n甲方采购设备，乙方供应并安装调试", "甲方委托乙方提供技术服务，向乙方支付服务费", "双方合作", "甲方负责验收", "随便", "《设备采购合同》\n乙方供货")


def base_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pairs of versions: what they are about, with what the pair came with first; counted."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(pick(_TEXTS, k).alias("before_text"), F.lit("").alias("after_text"), pick((None, "框架合同", " "), k).alias("contract_type"), F.lit(None).cast("string").alias("review_role"))
    out = base_info.pair_info(p).select("before_text", "base_info.*")
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n_pairs"))


BASE_SQL = f"""WITH c AS (SELECT c_custkey % 6 AS t, c_custkey % 3 AS g FROM customer)
SELECT ([{', '.join("replace(" + quoted(x.replace(chr(10), '~')) + ", '~', chr(10))" for x in _TEXTS)}])[t + 1] AS before_text, CASE
  WHEN g = 1 THEN '框架合同' ELSE (['采购合同', '技术服务合同', '合作协议', '通用合同', '通用合同', '采购合同'])[t + 1] END AS contract_type,
 (['乙方', '乙方', '通用角色', '甲方', '通用角色', '乙方'])[t + 1] AS review_role, (['采购', '服务事项', '通用合同事项', '通用合同事项', '通用合同事项', '设备采购'])[t + 1] AS contract_subject,
 (['采购方', '委托方', '合作方', NULL, NULL, '采购方'])[t + 1] AS party_a_identity, (['供应及安装调试方', '服务方', '合作方', NULL, NULL, '供应方'])[t + 1] AS party_b_identity,
  ([0.92::DOUBLE, 0.86::DOUBLE, 0.56::DOUBLE, 0.4::DOUBLE, 0.29::DOUBLE, 0.92::DOUBLE])[t + 1] AS confidence, count(*) AS n_pairs FROM c GROUP BY ALL"""


def partial_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers changed by the filled fields of a change, then the rows of two nations replaced as a whole."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    changes = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "renamed").alias("c_name"), F.when(F.col("c_custkey") % 6 == 0, "MOVED").alias("c_mktsegment"))
    out = tables.update_filled(c, changes, "c_custkey")
    fresh = c.where("c_nationkey IN (1, 2) AND c_custkey % 3 = 0")
    return tables.replace_children(out, fresh, "c_nationkey")


PARTIAL_SQL = """WITH f AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 2) AND c_custkey % 3 = 0)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 6 = 0 THEN 'MOVED'
  ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM f) UNION ALL SELECT * FROM f"""


def conformance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as items of their order's result: what each result breaks, and its total of risks; counted."""
    l, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")  # noqa: E741
    items = l.select("l_orderkey", pick(("high", "medium", "low", "pass"), "l_orderkey").alias("risk"), pick(("高风险", "中风险", "低风险", "通过"), F.col("l_orderkey") + F.when(k % 40 == 0, 1).otherwise(0)).alias("risk_label"), pick(("replace", "manual"), k).alias("action_type"), F.when(k % 50 != 0, "R").alias("rule_code"))
    totals = audit.counts(items, "l_orderkey")
    return audit.conformance(items, totals, "l_orderkey").groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count(F.lit(1)).alias("n_results"))


CONFORMANCE_SQL = """WITH r AS (SELECT l_orderkey, bool_or(l_partkey % 40 = 0) AS a, bool_or(l_partkey % 50 = 0) AS b FROM lineitem GROUP BY 1)
SELECT CASE WHEN a AND b THEN 'label_fits,code_present' WHEN a THEN 'label_fits' WHEN b THEN 'code_present' ELSE '' END AS issues,
  count(*) AS n_results FROM r GROUP BY ALL"""


def inserted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sessions that are inserted twice: one id each, dates as ISO text, and an end half an hour later."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("created_at"))
    rows = tables.inserted(e, ["user_id", "event_id"]).unionByName(tables.inserted(e, ["user_id", "event_id"])).dropDuplicates(["id"])
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    later = F.col("created_at") + F.expr("INTERVAL 1800 SECONDS")
    return rows.select("event_id", iso(F.col("created_at")).alias("created_at"), iso(later).alias("expires_at"), F.to_timestamp_ntz(iso(later)).alias("parsed"), F.length("id").alias("id_chars"))


INSERTED_SQL = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at, strftime(ts + INTERVAL 1800 SECOND, '%Y-%m-%dT%H:%M:%S') AS expires_at, date_trunc('second', ts::TIMESTAMP + INTERVAL 1800 SECOND)::TIMESTAMP AS parsed, 64 AS id_chars FROM events"""


def risk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' line items as risks: high and medium ones, and low ones that are more than wording."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", pick(("high", "medium", "low", "pass"), "l_partkey").alias("risk_level"), pick(("格式调整", "付款"), "l_suppkey").alias("summary"))  # noqa: E741
    return audit.total_risks(l, "l_orderkey", F.contains(F.col("summary"), F.lit("格式")))


RISK_TOTALS_SQL = "SELECT l_orderkey, count(*) FILTER (l_partkey % 4 < 2 OR (l_partkey % 4 = 2 AND l_suppkey % 2 = 1)) AS total_risks FROM lineitem GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (
        task_listing, task_retries, versions_newest, risk_owners, id_sets, account_links, rule_checks, rule_types, rule_projection, contract_outline, contract_clauses, segment_lookup, reference_terms, item_diffs,
        evidence_valid, answer_fields, base_infos, partial_updates, conformance_report, inserted_sessions, risk_totals,
    )
}
ORACLES = {
    "task_listing": TASK_LISTING_SQL, "task_retries": TASK_RETRIES_SQL, "versions_newest": VERSIONS_SQL, "risk_owners": RISK_OWNERS_SQL, "id_sets": ID_SETS_SQL, "account_links": ACCOUNTS_SQL, "rule_checks": RULE_CHECKS_SQL,
    "rule_types": RULE_TYPES_SQL, "rule_projection": RULE_PROJECTION_SQL, "contract_outline": OUTLINE_SQL, "contract_clauses": CLAUSES_SQL, "segment_lookup": SEGMENT_SQL, "reference_terms": REFERENCE_SQL, "item_diffs": ITEM_DIFFS_SQL,
    "evidence_valid": EVIDENCE_VALID_SQL, "answer_fields": ANSWER_SQL, "base_infos": BASE_SQL, "partial_updates": PARTIAL_SQL, "conformance_report": CONFORMANCE_SQL, "risk_totals": RISK_TOTALS_SQL, "inserted_sessions": INSERTED_SQL,
}
