"""Queries for retrieval and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieve
from ..operators.shared import folder_for, written
from ..streaming import sessions as S
from .documents import table


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 20, among all vectors."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.vector_topk(q, v.select("vec_id", "embedding"), 5).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"))


VECTOR_SQL = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 5"""


def _words(df: DataFrame, id: str, name: str) -> DataFrame:
    return df.select(F.col(id).alias(name), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))


def _tokens(df: DataFrame, id: str, name: str) -> DataFrame:
    """CJK runs, ASCII words and pairs of characters; a null text has none, as an empty one."""
    return df.select(F.col(id).alias(name), T.bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def _bm25(spark, sf_dir, tokens=_words):
    q = tokens(table(spark, sf_dir, "benchmark").where("item_id % 20 = 0"), "item_id", "query_id")
    return retrieve.bm25(q, tokens(table(spark, sf_dir, "documents"), "doc_id", "doc_id"))


_BM25 = """d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tk FROM documents), nd AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM d), tfc AS (SELECT doc_id, dl, term, count(*) AS tf FROM tf GROUP BY ALL),
dfc AS (SELECT term, count(*) AS df FROM tfc GROUP BY 1), raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM dfc, nd),
  mean AS (SELECT avg(raw) AS m FROM raw),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw, mean),
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 20 = 0),
  qc AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qc JOIN idf USING (term)
  JOIN tfc USING (term), nd GROUP BY ALL)"""


def bm25_topk(spark: SparkSession, sf_dir: str, tokens=_words) -> DataFrame:
    """The five best documents by BM25 for benchmark items whose id is divisible by 20."""
    s = _bm25(spark, sf_dir, tokens).withColumn("score", F.round("score", 6))
    return retrieve.ranked(s, "query_id", [F.desc("score"), "doc_id"], 5).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"))


BM25_SQL = f"WITH {_BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM bm) SELECT * FROM r WHERE rank <= 5"


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.vector_topk(q, v.select("vec_id", "embedding"), 100).withColumnRenamed("vec_id", "doc_id")


_VEC = "v AS (SELECT query_id, doc_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rk FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rk <= 100)"


def hybrid_fusion(spark: SparkSession, sf_dir: str, tokens=_words) -> DataFrame:
    """Vector top 100 and normalised BM25, weighted, filtered by language where any document is allowed."""
    terms = written(_bm25(spark, sf_dir, tokens), "term-scores")  # read twice, as what is fused is three times
    fused = written(retrieve.fuse(_vectors(spark, sf_dir), retrieve.max_normalized(terms)), "fused")
    langs = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id")
    allowed = fused.where("query_id % 40 = 0").select("query_id", "doc_id").join(langs, "doc_id")
    kept = retrieve.filter_open(fused, allowed).withColumn("score", F.round("score", 6))
    return retrieve.ranked(kept, "query_id", [F.desc("score"), "doc_id"], 10).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"))


HYBRID_SQL = f"""WITH {_BM25}, {_VEC}, t AS (SELECT query_id, doc_id, greatest(score, 0) / max(greatest(score, 0))
  OVER (PARTITION BY query_id) AS score FROM bm),
f AS (SELECT query_id, doc_id, 0.6 * coalesce(v.score, 0) + 0.4 * coalesce(t.score, 0) AS score FROM v FULL JOIN t USING (query_id, doc_id)),
a AS (SELECT query_id, doc_id FROM f JOIN documents USING (doc_id) WHERE query_id % 40 = 0 AND lang = 'de'),
k AS (SELECT * FROM f WHERE (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM a) OR query_id NOT IN (SELECT query_id FROM a)),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM k) SELECT * FROM r
  WHERE rank <= 10"""


def tiered_retrieval(spark: SparkSession, sf_dir: str, tokens=_words) -> DataFrame:
    """Filters by language and source, then language, then none: the first with any hit."""
    scored = _bm25(spark, sf_dir, tokens).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").withColumn("score", F.round("score", 6))
    tier = F.when((F.col("lang") == "es") & (F.col("source") == F.concat(F.lit("src"), F.col("query_id"))), 0).when(F.col("lang") == "es", 1).otherwise(2)
    best = retrieve.positional(retrieve.first_tier(scored, tier, 3).drop("score"))
    return best.select("query_id", "doc_id", "tier", F.col("rank").cast("int").alias("rank"), "score")


TIERED_SQL = f"""WITH {_BM25}, s AS (SELECT query_id, doc_id, round(score, 6) AS score, CASE WHEN lang = 'es' AND source = 'src' || query_id THEN 0
  WHEN lang = 'es' THEN 1 ELSE 2 END AS tier FROM bm JOIN documents USING (doc_id)),
m AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS least FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
  doc_id)::INT AS rank FROM m WHERE tier <= least)
SELECT query_id, doc_id, tier, rank, round(1 - (rank - 1) / greatest(count(*) OVER (PARTITION BY query_id), 10), 4) AS score FROM r WHERE rank <= 3"""


def bm25_topk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk with all tokens: CJK runs, ASCII words and pairs of characters."""
    return bm25_topk(spark, sf_dir, _tokens)


def hybrid_fusion_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_fusion(spark, sf_dir, _tokens)


def tiered_retrieval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_retrieval(spark, sf_dir, _tokens)


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as sparse hashed vectors."""
    e = retrieve.hashed_embedding(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return e.select("item_id", "slot", "weight", F.round("value", 9).alias("value"))


HASH_SQL = """WITH b AS (SELECT item_id, lower(text) AS t, regexp_replace(lower(text), '[ \\t\\r\\n]+', '', 'g') AS u FROM benchmark),
k AS (SELECT item_id, unnest(regexp_extract_all(t, '[a-z0-9_]+')) AS tok FROM b UNION ALL SELECT item_id, substring(u, i, n) FROM (SELECT item_id, u,
  n, unnest(range(1, length(u) - n + 2)) AS i FROM b, (VALUES (1), (2), (3), (4)) x(n))),
s AS (SELECT item_id, (('0x' || left(md5(tok), 8))::BIGINT % 512)::INT AS slot, CASE WHEN ('0x' || substring(md5(tok), 9, 2))::BIGINT % 2 = 0 THEN 1
  ELSE -1 END AS sign FROM k),
w AS (SELECT item_id, slot, sum(sign)::BIGINT AS weight FROM s GROUP BY ALL HAVING sum(sign) <> 0)
SELECT item_id, slot, weight, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY item_id)), 9) AS value FROM w"""


def hash_embedding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sparse hashed vectors."""
    e = retrieve.hashed_embedding(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return e.select("doc_id", "slot", "weight", F.round("value", 9).alias("value"))


def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind and of four rooms of users, unless one was kept in the five minutes before."""
    e = table(spark, sf_dir, "events").withColumn("room", F.pmod("user_id", F.lit(4)))
    return S.once_batch(e, ["room", "event_type"], "ts", "event_id", S.MESSAGE_TTL).select("event_id", "room", "event_type")


DEDUP_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id % 4 AS room, event_type, ts FROM events), f AS (SELECT room, event_type, min(ts) AS ts
  FROM e GROUP BY ALL
 UNION ALL SELECT f.room, f.event_type, min(e.ts) FROM f JOIN e ON e.room = f.room AND e.event_type = f.event_type
  AND e.ts >= f.ts + INTERVAL 300 SECOND GROUP BY f.room, f.event_type)
SELECT min(event_id) AS event_id, room, event_type FROM f JOIN e USING (room, event_type, ts) GROUP BY room, event_type, ts"""


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(table(spark, sf_dir, "events"))


SESSIONS_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM n GROUP BY user_id, k"""


def bm25_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of each language, an index of its own, for benchmark items whose id is divisible by 20."""
    q = _words(table(spark, sf_dir, "benchmark").where("item_id % 20 = 0"), "item_id", "query_id")
    d = table(spark, sf_dir, "documents")
    langs = d.select("lang").distinct()
    docs = d.select("doc_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))
    s = retrieve.bm25(q.crossJoin(langs), docs, "lang").join(d.select("doc_id", "lang"), "doc_id").withColumn("score", F.round("score", 6))
    return retrieve.ranked(s, ["query_id", "lang"], [F.desc("score"), "doc_id"], 3).select("query_id", "lang", "doc_id", F.col("rank").cast("int").alias("rank"))


BM25_LANG_SQL = """WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS tk FROM documents), nd AS (SELECT lang,
  count(*) AS n, avg(len(tk)) AS avgdl FROM d GROUP BY 1),
tf AS (SELECT doc_id, lang, len(tk) AS dl, unnest(tk) AS term FROM d), tfc AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM tf GROUP BY ALL),
dfc AS (SELECT lang, term, count(*) AS df FROM tfc GROUP BY ALL), raw AS (SELECT lang, term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM dfc
  JOIN nd USING (lang)), mean AS (SELECT lang, avg(raw) AS m FROM raw GROUP BY 1),
idf AS (SELECT lang, term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw JOIN mean USING (lang)),
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 20 = 0),
  qc AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
bm AS (SELECT query_id, lang, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qc JOIN idf USING (term)
  JOIN tfc USING (lang, term) JOIN nd USING (lang) GROUP BY ALL),
r AS (SELECT query_id, lang, doc_id, row_number() OVER (PARTITION BY query_id, lang ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM bm)
  SELECT * FROM r WHERE rank <= 3"""


def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of benchmark items, then those with an even id anew with a longer text: slots and largest weight of every vector."""
    b = table(spark, sf_dir, "benchmark")
    index = retrieve.index_append(None, b, "item_id", F.col("text"))
    index = retrieve.index_append(index, b.where("item_id % 2 = 0"), "item_id", F.concat("text", F.lit(" second version")))
    return index.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_slots"), F.round(F.max("value"), 6).alias("largest"))


def vector_sql(name: str, source: str, id: str) -> str:
    """name_v (id, slot, v): hashed vectors of the texts of a table or a query."""
    return f"""{name}_b AS (SELECT {id} AS id, lower(coalesce(text, '')) AS t, regexp_replace(lower(coalesce(text, '')), '[ \\t\\r\\n]+', '',
  'g') AS u FROM {source}),
{name}_k AS (SELECT id, unnest(regexp_extract_all(t, '[a-z0-9_]+')) AS tok FROM {name}_b
 UNION ALL SELECT id, substring(u, i, n) FROM (SELECT id, u, n, unnest(range(1, length(u) - n + 2)) AS i FROM {name}_b, (VALUES (1), (2), (3), (4)) x(n))),
{name}_s AS (SELECT id, md5(tok) AS h, count(*) AS n FROM {name}_k GROUP BY ALL),
{name}_w AS (SELECT id, (('0x' || left(h, 8))::BIGINT % 512)::INT AS slot, sum(CASE WHEN ('0x' || substring(h, 9, 2))::BIGINT % 2 = 0 THEN n
  ELSE -n END)::BIGINT AS weight FROM {name}_s GROUP BY ALL),
{name}_v AS (SELECT id, slot, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS v FROM {name}_w WHERE weight <> 0)"""


_NEWER = "(SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text || ' second version' ELSE text END AS text FROM benchmark)"
INDEX_SQL = f"WITH {vector_sql('b', _NEWER, 'item_id')} SELECT id AS item_id, count(*) AS n_slots, round(max(v), 6) AS largest FROM b_v GROUP BY 1"


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings at unit length, and their inner product with the vector itself."""
    v = table(spark, sf_dir, "embeddings")
    u = T.unit(F.transform("embedding", lambda x: x.cast("double")))
    return v.select("vec_id", F.round(T.inner_product(u, F.col("embedding")), 6).alias("length"), F.round(T.inner_product(u, u), 6).alias("one"))


UNIT_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, e, list_transform(e,
  lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v)
SELECT vec_id, round(list_inner_product(u, e), 6) AS length, round(list_inner_product(u, u), 6) AS one FROM u"""


QUERIES = {f.__name__: f for f in (vector_topk, bm25_topk, hybrid_fusion, tiered_retrieval, bm25_topk_tokens, hybrid_fusion_tokens, tiered_retrieval_tokens, hash_embedding, hash_embedding_documents, bm25_by_language, index_upkeep, unit_vectors, event_dedup, user_sessions)}
ORACLES = {"vector_topk": VECTOR_SQL, "bm25_topk": BM25_SQL, "hybrid_fusion": HYBRID_SQL, "tiered_retrieval": TIERED_SQL, "hash_embedding": HASH_SQL, "event_dedup": DEDUP_SQL, "user_sessions": SESSIONS_SQL, "bm25_by_language": BM25_LANG_SQL, "index_upkeep": INDEX_SQL, "unit_vectors": UNIT_SQL}
