"""Queries over documents: paragraphs, masking, keywords, sections, versions, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, text as T
from ..operators import audit, diff, locate, redact, segment, shared, splice, versions

#: Words of the driver's Latin texts, in the place of the Chinese key words: module and its words, in order.
MODULES_LATIN = (("license", ["Licen", "licen"]), ("contact", ["@", "+1 ("]), ("secret", ["token", "key ="]), ("table", [" | "]), ("shout", ["!!"]))
KEY_LATIN = ("@", "token", "Licen")
LEVELS = (("license", "low"), ("contact", "high"), ("secret", "high"), ("table", "medium"), ("shout", "medium"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paras(spark, sf_dir):
    return segment.paragraphs(table(spark, sf_dir, "documents"), headings=labels.HEADINGS_LATIN, key_words=KEY_LATIN)


_P = """
lines AS (SELECT doc_id, i - 1 AS line, trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
          FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
paras AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS paragraph_index, text,
                 (coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS char_offset_start
          FROM lines WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line))"""


def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paras(spark, sf_dir)


_HEAD = """CASE WHEN length(text) > 200 OR length(text) < 2 THEN 'body' WHEN regexp_matches(text, '^(Section|Article|Chapter) [0-9]+') THEN 'heading2'
 WHEN regexp_matches(text, '^[0-9]+[.)]') THEN 'heading3' WHEN regexp_matches(text, '^[A-Z][a-z]{1,19}[.]?$') THEN 'heading1' ELSE 'body' END"""
DOC_PARAGRAPHS_SQL = f"""WITH {_P}, k AS (SELECT *, {_HEAD} AS paragraph_type FROM paras)
SELECT doc_id, paragraph_index, text, char_offset_start, char_offset_start + length(text)::INT AS char_offset_end, paragraph_type,
 CASE paragraph_type WHEN 'heading1' THEN 1 WHEN 'heading2' THEN 2 WHEN 'heading3' THEN 3 ELSE 0 END AS paragraph_level,
 contains(text, '@') OR contains(text, 'token') OR contains(text, 'Licen') AS is_key_clause FROM k"""


def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their ranges in the whole text."""
    return segment.sentences(_paras(spark, sf_dir), ends=".!?")


DOC_SENTENCES_SQL = f"""WITH {_P},
s AS (SELECT doc_id, paragraph_index, char_offset_start AS base, length(regexp_extract(text, '^[.!?]+')) AS lead, regexp_extract_all(text,
  '[^.!?]+[.!?]*') AS l FROM paras),
e AS (SELECT doc_id, paragraph_index, base + lead AS base, l, unnest(range(1, len(l) + 1)) AS i FROM s)
SELECT doc_id, paragraph_index, (i - 1)::INT AS sentence_in_paragraph, l[i] AS text,
 (base + coalesce(list_sum(list_transform(l[1:i-1], lambda x: length(x))), 0))::INT AS char_offset_start,
 (base + list_sum(list_transform(l[1:i], lambda x: length(x))))::INT AS char_offset_end FROM e"""


def mask_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.mask(F.col("text")).alias("masked"))


def _mask_sql(column: str) -> str:
    for pattern, token in T.MASKS_LATIN:
        column = f"regexp_replace({column}, '{pattern}', '{token}', 'g')"
    return column


MASK_BASIC_SQL = f"SELECT doc_id, {_mask_sql('text')} AS masked FROM documents"


def redact_reversible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted text, number of mappings, and whether the map leads back to the text."""
    r = redact.restored(redact.redact(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return r.select("doc_id", F.sha2("sanitized_text", 256).alias("sanitized_sha256"), F.size("mappings").alias("n_mappings"), (F.col("restored_text") == F.col("text")).alias("round_trip"))


def redact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents come back unchanged."""
    return redact_reversible(spark, sf_dir).groupBy("round_trip").agg(F.count(F.lit(1)).alias("n_docs"))


REDACT_ROUNDTRIP_SQL = "SELECT true AS round_trip, count(*) AS n_docs FROM documents"


def _triggers(paras):
    module = labels.cascade(F.col("text"), MODULES_LATIN, "general")
    level = F.when(module.isin("contact", "secret"), "high").when(module.isin("table", "shout"), "medium").when(module == "license", "low").otherwise("pass")
    return paras.withColumn("module", module).withColumn("risk", level)


_TRIGGER = """CASE WHEN contains(text, 'Licen') OR contains(text, 'licen') THEN 'license' WHEN contains(text, '@') OR contains(text, '+1 (') THEN 'contact'
 WHEN contains(text, 'token') OR contains(text, 'key =') THEN 'secret' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout'
  ELSE 'general' END"""
_RISK = "CASE WHEN module IN ('contact', 'secret') THEN 'high' WHEN module IN ('table', 'shout') THEN 'medium' WHEN module = 'license' THEN 'low' ELSE 'pass' END"


def keyword_trigger_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by module of the ordered cascade, by language."""
    hits = _triggers(_paras(spark, sf_dir)).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return hits.groupBy("lang", "module").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.countDistinct("doc_id").alias("n_docs"))


KEYWORD_SQL = f"WITH {_P} SELECT lang, module, count(*) AS n_paragraphs, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, {_TRIGGER} AS module FROM paras) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang, module"


def doc_risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of paragraphs by risk, as strings, and masked paragraphs, of each document."""
    hits = _triggers(_paras(spark, sf_dir))
    return audit.counts(hits, "doc_id", F.count_if(T.mask(F.col("text")) != F.col("text")).alias("n_masked"))


DOC_RISK_SQL = f"""WITH {_P}, h AS (SELECT doc_id, text, {_TRIGGER} AS module FROM paras), r AS (SELECT doc_id, {_RISK} AS risk,
  {_mask_sql('text')} <> text AS m FROM h)
SELECT doc_id, count(*) FILTER (risk = 'pass')::VARCHAR AS "agreeCount", count(*) FILTER (risk = 'high')::VARCHAR AS "highlevelriskCount",
 count(*) FILTER (risk = 'medium')::VARCHAR AS "mediumlevelriskCount", count(*) FILTER (risk = 'low')::VARCHAR AS "lowlevelriskCount",
  count(*) FILTER (m) AS n_masked FROM r GROUP BY doc_id"""


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character-set similarity of the stated set of benchmark items (ids divisible by 20) with all items."""
    b = table(spark, sf_dir, "benchmark")
    a = b.where("item_id % 20 = 0").select(F.col("item_id").alias("a_id"), F.col("text").alias("a"))
    c = b.select(F.col("item_id").alias("b_id"), F.col("text").alias("b"))
    return a.join(c, F.col("a_id") != F.col("b_id")).select("a_id", "b_id", F.round(T.char_jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


JACCARD_SQL = """WITH c AS (SELECT item_id, list_distinct(regexp_extract_all(text, '(?s).')) AS s FROM benchmark)
SELECT a.item_id AS a_id, b.item_id AS b_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity
FROM c a JOIN c b ON a.item_id <> b.item_id WHERE a.item_id % 20 = 0"""


#: Benchmark items of one block; a sentence meets a block at a time.
ITEMS = 64


def jaccard_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character-set similarity of benchmark items whose id is divisible by 20 with every sentence of documents, in blocks of items."""
    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    n = max(1, -(-items.count() // ITEMS))
    blocks = items.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n))).agg(F.collect_list(F.struct("item_id", T.chars(F.col("text")).alias("item"))).alias("block")).select("block")
    place = ["doc_id", "paragraph_index", "sentence_in_paragraph"]
    # each text's characters are told apart once, not once a pair
    met = doc_sentences(spark, sf_dir).select(*place, T.chars(F.col("text")).alias("sentence")).crossJoin(blocks).select(*place, "sentence", F.inline("block"))
    return met.select("item_id", *place, F.round(T.set_jaccard(F.col("item"), F.col("sentence")), 6).alias("similarity"))


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of documents most similar to each of those items; of equal ones the first."""
    place = [F.col(c) for c in ("doc_id", "paragraph_index", "sentence_in_paragraph")]
    best = F.max_by(F.struct(*place, "similarity"), F.struct("similarity", *[-c for c in place]))
    return jaccard_sentences(spark, sf_dir).groupBy("item_id").agg(best.alias("m")).select("item_id", "m.*")


def _evidence(spark, sf_dir):
    """A quote for each document: of even ones their longest paragraph's first 60 characters, of odd ones a whole benchmark item."""
    paras = _paras(spark, sf_dir)
    own = paras.where("doc_id % 2 = 0").groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("paragraph_index"))).alias("t"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("evidence"))
    other = table(spark, sf_dir, "documents").where("doc_id % 2 = 1").select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(items, "item_id")
    quote = own.select("doc_id", F.substring("t", 1, 60).alias("evidence")).unionByName(other.select("doc_id", "evidence"))
    return paras, quote.select("doc_id", F.col("doc_id").alias("evidence_id"), T.strip(F.col("evidence")).alias("evidence"))


def evidence_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras, quote = _evidence(spark, sf_dir)
    return locate.best_paragraph(quote, paras)


EVIDENCE_SQL = f"""WITH {_P}, q0 AS (SELECT doc_id, left(arg_max(text, (length(text), -paragraph_index)), 60) AS e FROM paras WHERE doc_id % 2 = 0
  GROUP BY doc_id UNION ALL SELECT doc_id, b.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 WHERE doc_id % 2 = 1),
q AS (SELECT doc_id, trim(e) AS e, list_distinct(regexp_extract_all(trim(e), '(?s).')) AS ec FROM q0 WHERE trim(e) <> ''),
j AS (SELECT p.doc_id, p.paragraph_index, p.text, p.char_offset_start AS s, q.e, len(ec) AS n, CASE WHEN contains(p.text, q.e)
  OR contains(regexp_replace(p.text, '\\s+', ' ', 'g'), regexp_replace(q.e, '\\s+', ' ', 'g')) THEN length(q.e) / length(p.text) WHEN contains(q.e,
  p.text) THEN length(p.text) / length(q.e) ELSE 0 END AS score,
 len(list_intersect(ec, list_distinct(regexp_extract_all(p.text, '(?s).')))) AS common FROM paras p JOIN q USING (doc_id)),
b AS (SELECT doc_id, e, n, max(score) AS top, max(common) AS most, arg_max({{'i': paragraph_index, 't': text, 's': s}}, (score,
  -paragraph_index)) AS m1, arg_max({{'i': paragraph_index, 't': text, 's': s}}, (common, -paragraph_index)) AS m2 FROM j GROUP BY doc_id, e, n),
c AS (SELECT *, CASE WHEN top > 0 THEN m1 ELSE m2 END AS m FROM b WHERE top > 0 OR most >= n * 0.5)
SELECT doc_id, doc_id AS evidence_id, m.i AS paragraph_index, (m.s + greatest(instr(m.t, e), 1) - 1)::INT AS char_offset_start,
 (CASE WHEN contains(m.t, e) THEN m.s + instr(m.t, e) - 1 + length(e) ELSE m.s + length(m.t) END)::INT AS char_offset_end,
 CASE WHEN top > 0 THEN CASE WHEN contains(m.t, e) THEN 'containment_exact' ELSE 'containment_paragraph' END WHEN contains(m.t,
  e) THEN 'overlap_exact' ELSE 'overlap' END AS match_strategy FROM c"""


def evidence_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of its document for each quote, by tier."""
    paras, quote = _evidence(spark, sf_dir)
    s = segment.sentences(paras, ends=".!?").withColumn("sentence_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("char_offset_start")))
    return locate.best_sentence(quote, s)


#: The version ids of a folder's documents that an application has written.
_VERSION_IDS: dict[tuple[str, str], str] = {}


def _version_ids(spark, sf_dir, d):
    """Written once for all queries that compare versions."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VERSION_IDS or not shared.names_in(spark, _VERSION_IDS[key]):
        folder = shared.folder_for(spark, "version-ids")
        versions.version_ids(d).write.parquet(folder)
        _VERSION_IDS[key] = folder
    return spark.read.schema("doc_id long, old_id long").parquet(_VERSION_IDS[key])


def _versions(spark, sf_dir):
    """Each document with the nearest lower id among its copies and near-duplicates: an old and a new version."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = _version_ids(spark, sf_dir, d).join(d.select(F.col("doc_id").alias("old_id"), F.col("text").alias("old")), "old_id")
    return pairs.join(d, "doc_id").select(F.col("doc_id").alias("pair_id"), "old", F.col("text").alias("new"))


def section_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as sections: users' against assistants', full outer by turn's place."""
    c = table(spark, sf_dir, "conversations")
    side = lambda role: c.where(F.col("role") == role).select("conv_id", F.concat(F.lit("#"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).alias("section_key"), F.col("turn").alias("position"), "text")
    return segment.section_pairs(side("user"), side("assistant"), "conv_id")


SECTION_SQL = """WITH s AS (SELECT conv_id, role, '#' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS section_key, turn, text
  FROM conversations),
o AS (SELECT * FROM s WHERE role = 'user'), n AS (SELECT * FROM s WHERE role = 'assistant')
SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(o.section_key, n.section_key) AS section_key, o.turn AS old_position, n.turn AS new_position,
 coalesce(o.text, '') AS old_text, coalesce(n.text, '') AS new_text, o.text IS NOT DISTINCT FROM n.text AS unchanged FROM o FULL
  JOIN n ON o.conv_id = n.conv_id AND o.section_key = n.section_key"""


def sentence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    pairs = v.select("pair_id", T.compared_sentences(F.col("old"), ".!?\n").alias("old_sentences"), T.compared_sentences(F.col("new"), ".!?\n").alias("new_sentences"))
    return diff.sentence_diff(pairs).withColumn("similarity", F.round("similarity", 6))


def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.summarize(sentence_diff(spark, sf_dir), "pair_id").drop("added_texts", "deleted_texts")


def clause_diff_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).where("old <> new")  # exact copies have no differences
    old, new = (segment.clauses(v.select("pair_id", F.translate(c, ".", "。").alias("t")), "pair_id", "t") for c in ("old", "new"))
    return diff.clause_diff(old, new).select("pair_id", "diff_id", "change_type", "before", "after", "review_module", "is_substantive", "confidence")


def _spans(spark, sf_dir):
    """Two spans of each document from its id: one at the start, one later; some overlap."""
    d = table(spark, sf_dir, "documents")
    a = F.struct((F.col("doc_id") % 7).cast("int").alias("start"), (F.col("doc_id") % 7 + 5).cast("int").alias("end"))
    b = F.struct((F.col("doc_id") % 11).cast("int").alias("start"), (F.col("doc_id") % 11 + 4).cast("int").alias("end"))
    return d, d.select("doc_id", F.inline(F.array(a, b)))


def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splice.check_spans(_spans(spark, sf_dir)[1], "doc_id").groupBy("problem").agg(F.count(F.lit(1)).alias("n_spans"))


OVERLAP_SQL = """WITH s AS (SELECT doc_id, doc_id % 7 AS st, doc_id % 7 + 5 AS en FROM documents UNION ALL SELECT doc_id, doc_id % 11, doc_id % 11 + 4
  FROM documents),
c AS (SELECT st, lag(en) OVER (PARTITION BY doc_id ORDER BY st, en) AS b FROM s) SELECT CASE WHEN b IS NOT NULL
  AND st < b THEN 'overlaps' END AS problem, count(*) AS n_spans FROM c GROUP BY 1"""


def span_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = _spans(spark, sf_dir)
    out = splice.apply_spans(d.select("doc_id", "text"), s.withColumn("replace_text", F.concat(F.lit("<"), "start", F.lit(">"))), "doc_id")
    return out.select("doc_id", F.sha2("spliced_text", 256).alias("spliced_sha256"))


SPLICE_SQL = """WITH s AS (SELECT doc_id, text, least(doc_id % 7, doc_id % 11) AS a, CASE WHEN doc_id % 7 <= doc_id % 11 THEN doc_id % 7 + 5
  ELSE doc_id % 11 + 4 END AS ae,
 greatest(doc_id % 7, doc_id % 11) AS b, CASE WHEN doc_id % 7 > doc_id % 11 THEN doc_id % 7 + 5 ELSE doc_id % 11 + 4 END AS be FROM documents)
SELECT doc_id, CASE WHEN b >= ae AND a <> b THEN sha256(t[1:a] || '<' || a || '>' || t[ae+1:]) END AS spliced_sha256
FROM (SELECT *, text[1:b] || '<' || b || '>' || text[be+1:] AS t FROM s)"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of pages: scripts, styles and tags removed, white space folded."""
    t = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t, 256).alias("text_sha256"), F.length(t).cast("long").alias("n_chars"))


PAGE_TEXT_SQL = r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html,
  '(?s)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages)
SELECT page_id, sha256(t) AS text_sha256, length(t) AS n_chars FROM t"""

QUERIES = {f.__name__: f for f in (doc_paragraphs, doc_sentences, mask_basic, redact_reversible, redact_roundtrip, keyword_trigger_hits, doc_risk_summary, jaccard_pairs, jaccard_sentences, best_match, evidence_paragraph, evidence_sentence, section_outer_join, sentence_diff, diff_stats, clause_diff_moves, overlap_check, span_splice, page_text)}
ORACLES = {
    "doc_paragraphs": DOC_PARAGRAPHS_SQL, "doc_sentences": DOC_SENTENCES_SQL, "mask_basic": MASK_BASIC_SQL, "redact_roundtrip": REDACT_ROUNDTRIP_SQL,
    "keyword_trigger_hits": KEYWORD_SQL, "doc_risk_summary": DOC_RISK_SQL, "jaccard_pairs": JACCARD_SQL, "evidence_paragraph": EVIDENCE_SQL,
    "section_outer_join": SECTION_SQL, "overlap_check": OVERLAP_SQL, "span_splice": SPLICE_SQL, "page_text": PAGE_TEXT_SQL,
}
