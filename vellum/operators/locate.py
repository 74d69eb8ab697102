"""Evidence back to its place: the paragraph or sentence of the same document that fits best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _ws(c):
    return T.strip(F.regexp_replace(c, r"(?U)\s+", " "))


def best_paragraph(evidence: DataFrame, paras: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """evidence: (id, evidence_id, evidence). Containment by share of length first, else the most common characters.

    An equi-join on the document with the rest as expressions; the best is an aggregate, so nothing is sorted.
    """
    p = paras.select(id_col, "paragraph_index", F.col("text").alias("p_text"), F.col("char_offset_start").alias("p_start"), F.col("char_offset_end").alias("p_end"))
    both = evidence.where("evidence <> ''").join(p.where("p_text <> ''"), id_col)
    e, t = F.col("evidence"), F.col("p_text")
    inside = F.contains(t, e) | F.contains(_ws(t), _ws(e))
    score = F.when(inside, F.length(e) / F.length(t)).when(F.contains(e, t), F.length(t) / F.length(e)).otherwise(0.0)
    common = F.size(F.array_intersect(T.chars(e), T.chars(t)))
    both = both.withColumn("score", score).withColumn("common", common)
    fit = lambda by: F.max_by(F.struct("paragraph_index", "p_text", "p_start", "p_end", "score", "common"), F.struct(by, -F.col("paragraph_index")))
    best = both.groupBy(id_col, "evidence_id", "evidence").agg(fit("score").alias("c"), fit("common").alias("o"))
    by_text = F.col("c.score") > 0
    enough = F.col("o.common") >= F.size(T.chars(e)) * 0.5
    best = best.withColumn("m", F.when(by_text, F.col("c")).when(enough, F.col("o"))).where("m IS NOT NULL")
    at = F.instr(F.col("m.p_text"), F.col("evidence"))
    start = F.when(at > 0, F.col("m.p_start") + at - 1).otherwise(F.col("m.p_start"))
    end = F.when(at > 0, start + F.length(e)).otherwise(F.col("m.p_end"))
    how = F.concat(F.when(by_text, "containment").otherwise("overlap"), F.when(at > 0, "_exact").otherwise(F.when(by_text, "_paragraph").otherwise("")))
    return best.select(id_col, "evidence_id", "m.paragraph_index", start.alias("char_offset_start"), end.alias("char_offset_end"), how.alias("match_strategy"))


def best_sentence(evidence: DataFrame, sents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Three tiers: containment (2 or 1.5), then keywords met, then similarity of characters of 0.3 or more."""
    s = sents.select(id_col, "sentence_index", F.col("text").alias("s_text"))
    # the evidence is taken apart once, not once a sentence
    asked = evidence.where("evidence <> ''").withColumns({"_k": T.keywords(F.col("evidence")), "_c": T.chars(T.clean(F.col("evidence")))})
    both = asked.join(s, id_col)
    e, t = F.col("evidence"), F.col("s_text")
    inside = F.when(F.contains(t, e) | F.contains(e, t), F.when(F.length(e) <= F.length(t), 2.0).otherwise(1.5)).otherwise(0.0)
    met = F.size(F.filter("_k", lambda k: F.contains(t, k))).cast("double")
    both = both.withColumn("inside", inside).withColumn("met", met).withColumn("like", T.let(T.chars(T.clean(t)), lambda c: T.set_jaccard(F.col("_c"), c)))
    fit = lambda by: F.max_by(F.struct("sentence_index", F.col(by).alias("score")), F.struct(by, -F.col("sentence_index")))
    best = both.groupBy(id_col, "evidence_id").agg(fit("inside").alias("a"), fit("met").alias("b"), fit("like").alias("c"))
    pick = F.when(F.col("a.score") >= 1, F.struct(F.lit("containment").alias("tier"), "a.*")).when(F.col("b.score") >= 1, F.struct(F.lit("keywords").alias("tier"), "b.*")).when(F.col("c.score") >= 0.3, F.struct(F.lit("similarity").alias("tier"), "c.*"))
    return best.withColumn("m", pick).where("m IS NOT NULL").select(id_col, "evidence_id", "m.sentence_index", "m.tier", "m.score")
