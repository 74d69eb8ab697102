"""Queries over stored indexes, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases, index, retrieve
from ..operators.shared import folder_for
from .documents import table
from .retrieval import vector_sql


def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of each language by a stored index: without a third of them, then with these and without a fifth."""
    d = table(spark, sf_dir, "documents")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    docs = d.select(F.col("lang").alias("module"), "doc_id", words("text").alias("tokens"))
    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), words("text").alias("tokens"))
    queries = items.select("query_id", "tokens", F.explode(F.array(*map(F.lit, ("en", "de", "fr", "es")))).alias("module"))
    store = index.TermIndex(spark, folder_for(spark, "terms"), parts=16)
    steps = []

    def step(n: int) -> None:
        scores = store.search(queries).withColumn("score", F.round("score", 6))
        best = retrieve.ranked(scores, ["query_id", "module"], [F.desc("score"), "doc_id"], 3).withColumn("step", F.lit(n))
        path = folder_for(spark, "found")
        best.write.parquet(path)  # what the index says now, not after the next change
        steps.append(spark.read.parquet(path))

    store.append(docs.where("doc_id % 3 <> 0"))
    step(1)
    store.append(docs.where("doc_id % 3 = 0"))
    store.withdraw(docs.where("doc_id % 5 = 0").select("module", "doc_id"))
    step(2)
    return steps[0].unionByName(steps[1]).select("step", "query_id", F.col("module").alias("lang"), "doc_id", F.col("rank").cast("int").alias("rank"))


def _bm25_sql(n: int, where: str) -> str:
    return f"""SELECT {n} AS step, * FROM (WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS tk FROM documents WHERE {where}),
nd AS (SELECT lang, count(*) AS n, avg(len(tk)) AS avgdl FROM d GROUP BY 1),
tf AS (SELECT doc_id, lang, len(tk) AS dl, unnest(tk) AS term FROM d), tfc AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM tf GROUP BY ALL),
dfc AS (SELECT lang, term, count(*) AS df FROM tfc GROUP BY ALL), raw AS (SELECT lang, term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM dfc
  JOIN nd USING (lang)),
mean AS (SELECT lang, avg(raw) AS m FROM raw GROUP BY 1), idf AS (SELECT lang, term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw
  JOIN mean USING (lang)),
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 20 = 0),
  qc AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
bm AS (SELECT query_id, lang, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qc JOIN idf USING (term)
  JOIN tfc USING (lang, term) JOIN nd USING (lang) GROUP BY ALL),
r AS (SELECT query_id, lang, doc_id, row_number() OVER (PARTITION BY query_id, lang ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM bm)
  SELECT * FROM r WHERE rank <= 3)"""


TERM_INDEX_SQL = _bm25_sql(1, "doc_id % 3 <> 0") + " UNION ALL " + _bm25_sql(2, "doc_id % 5 <> 0")

#: What the searches of local_index_search ask for, by the item's id: a module, a type and a role that there are, or not all of them.
WANTS = (("m1", "t1", "甲方"), ("m1", "t1", "nobody"), ("m1", "no such", None), ("none", "t0", "甲方"), (None, None, None), ("m2", None, "乙方"))


def local_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as cases in an index of hashed vectors; every benchmark item asks for the three best in its first tier with any."""
    c = table(spark, sf_dir, "conversations")
    id = F.col("conv_id") * 100 + F.col("turn")
    one = lambda prefix, n: F.concat(F.lit(prefix), F.pmod("conv_id", F.lit(n)))
    roles = F.when(F.col("role") == "user", F.array(F.lit("甲方"))).when(F.col("role") == "assistant", F.array(F.lit("乙方"))).otherwise(F.array(F.lit("丙方"), F.lit("乙方")))
    records = c.select(id.alias("id"), one("m", 4).alias("module"), F.array(one("t", 3)).alias("types"), roles.alias("roles"), F.coalesce("text", F.lit("")).alias("text"))
    path = folder_for(spark, "vectors")
    index.build_vectors(records, path, block=32)
    wants = F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(w, ("want_module", "want_type", "want_role"), strict=True)]) for w in WANTS])
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.get(wants, F.pmod("item_id", F.lit(len(WANTS))).cast("int")).alias("w"))
    found = index.search_vectors(q.select("query_id", "query", "w.*"), path, 3)
    return retrieve.strong(found).select("query_id", "id", "tier", F.col("rank").cast("int").alias("rank"))


LOCAL_SEARCH_SQL = f"""WITH {vector_sql('c', 'conversations', '(conv_id * 100 + turn)')}, {vector_sql('q', 'benchmark', 'item_id')},
r AS (SELECT conv_id * 100 + turn AS id, 'm' || conv_id % 4 AS module, 't' || conv_id % 3 AS type, CASE role WHEN 'user' THEN ['甲方']
  WHEN 'assistant' THEN ['乙方'] ELSE ['丙方', '乙方'] END AS roles FROM conversations),
a AS (SELECT item_id AS query_id, [{', '.join(f"'{m}'" if m else 'NULL' for m, _, _ in WANTS)}][item_id % {len(WANTS)} + 1] AS wm,
  [{', '.join(f"'{t}'" if t else 'NULL' for _, t, _ in WANTS)}][item_id % {len(WANTS)} + 1] AS wt,
 [{', '.join(f"'{x}'" if x else 'NULL' for _, _, x in WANTS)}][item_id % {len(WANTS)} + 1] AS wr FROM benchmark),
t AS (SELECT query_id, id, coalesce(wm = module, true) AS m, coalesce(wt = type, true) AS ty, wr IS NULL OR list_contains(list_transform(roles,
  lambda x: CASE x WHEN '甲方' THEN 'A' WHEN '乙方' THEN 'B' ELSE 'G' END), CASE wr WHEN '甲方' THEN 'A' WHEN '乙方' THEN 'B' ELSE 'G' END) AS ro FROM a, r),
f AS (SELECT query_id, id, CASE WHEN m AND ty AND ro THEN 0 WHEN m AND ty THEN 1 WHEN m THEN 2 ELSE 3 END AS tier FROM t),
l AS (SELECT query_id, id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS least FROM f) WHERE tier = least),
p AS (SELECT q_v.id AS query_id, c_v.id, sum(q_v.v * c_v.v) AS score FROM q_v JOIN c_v USING (slot) GROUP BY ALL),
s AS (SELECT query_id, id, tier, round(coalesce(score, 0), 6) AS score FROM l LEFT JOIN p USING (query_id, id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s)
SELECT query_id, id, tier, rank FROM k WHERE rank <= 3 AND score >= 0.02"""

#: Cases that stand in where no search finds any.
FIXED = (-1, -2)


def case_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each item's cases come from: a term search that every third item is allowed, else the local index, else fixed cases."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    c = table(spark, sf_dir, "conversations").select(F.lit("all").alias("module"), (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), F.coalesce(words, F.array()).alias("tokens"))
    store = index.TermIndex(spark, folder_for(spark, "case-terms"), parts=16)
    store.append(c)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("module"), words.alias("tokens"))
    by_terms = retrieve.ranked(store.search(items.where("query_id % 3 = 0")), "query_id", [F.desc("score"), "doc_id"], 3).select("query_id", F.col("doc_id").alias("id"))
    fixed = items.select("query_id", F.explode(F.array(*[F.lit(x).cast("long") for x in FIXED])).alias("id"))
    found = cases.standing_in(["query_id"], by_terms, local_index_search(spark, sf_dir).select("query_id", "id"), fixed)
    return found.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n_cases"))


CHAIN_SQL = f"""WITH found AS ({LOCAL_SEARCH_SQL}), l AS (SELECT query_id, count(*) AS n FROM found GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 3 = 0),
d AS (SELECT conv_id * 100 + turn AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM conversations),
t AS (SELECT query_id, count(DISTINCT id) AS n FROM q JOIN d USING (term) GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN t.n > 0 THEN 0 WHEN l.n > 0 THEN 1 ELSE 2 END AS source, CASE WHEN t.n > 0 THEN least(t.n, 3) WHEN l.n > 0 THEN l.n ELSE {len(FIXED)} END AS n_cases
FROM benchmark LEFT JOIN t ON t.query_id = item_id LEFT JOIN l ON l.query_id = item_id"""

QUERIES = {f.__name__: f for f in (term_index, local_index_search, case_chain)}
ORACLES = {"term_index": TERM_INDEX_SQL, "local_index_search": LOCAL_SEARCH_SQL, "case_chain": CHAIN_SQL}
