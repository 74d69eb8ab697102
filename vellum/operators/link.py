"""Look-ups between results: quotes to differences, texts to sentences, neighbours, accounts, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def item_to_diff(items: DataFrame, diffs: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """items with diff_index: the first difference of the pair and change type whose texts hold a quote of the item."""
    d = diffs.select(pair_col, "change_type", "diff_index", F.coalesce("old_text", F.lit("")).alias("_o"), F.coalesce("new_text", F.lit("")).alias("_n"))
    has = lambda text, quote: (F.col(quote) != "") & F.contains(text, quote)
    hit = has("_o", "old_quote") | has("_n", "new_quote") | has("_o", "original") | has("_n", "original")
    found = items.join(d, [pair_col, "change_type"]).where(hit).groupBy("item_id").agg(F.min("diff_index").alias("diff_index"))
    return items.join(found, "item_id", "left")


def text_to_sentence(diffs: DataFrame, sentences: DataFrame, text_col: str, doc_col: str) -> DataFrame:
    """diffs with sentence_index: the first sentence of the document with an equal text."""
    s = sentences.groupBy(doc_col, F.col("text").alias(text_col)).agg(F.min("sentence_index").alias("sentence_index"))
    return diffs.join(s, [doc_col, text_col], "left")


def neighbours(segments: DataFrame, hits: DataFrame, doc_col: str, window: int = 1) -> DataFrame:
    """hits (doc, order) with the segments around: an equi-join on each offset of the window, not a range join."""
    around = hits.select(doc_col, F.col("order").alias("hit"), F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("offset")).withColumn("order", F.col("hit") + F.col("offset"))
    return around.join(segments, [doc_col, "order"])


def _met(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides are never broadcast: all of a pack's sides grow with the documents, and many at once fill the driver."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def link_accounts(logins: DataFrame, users: DataFrame) -> DataFrame:
    """logins with user_id by the first identity of the cascade that a user has: open id, union id, mail, phone."""
    cascade = (("open_id", "open_id"), ("union_id", "union_id"), ("email", "email"), ("mobile", "phone"))
    out = logins
    for theirs, ours in cascade:
        u = users.where(F.col(ours).isNotNull() & (F.col(ours) != "")).groupBy(F.col(ours).alias(theirs)).agg(F.min("user_id").alias(f"_{theirs}"))
        out = out.join(u, theirs, "left")
    found = [f"_{theirs}" for theirs, _ in cascade]
    return out.withColumn("user_id", F.coalesce(*found)).drop(*found)


def account_id(*keys: Column) -> Column:
    """An id for a login that no account fits, made from its first filled identity."""
    first = F.coalesce(*[T.blank_to_null(k) for k in keys])
    return F.when(first.isNotNull(), F.sha2(first, 256))


#: Terms whose places in a contract are looked up where a change names them.
REFERENCES_ZH = ("附件", "验收标准", "服务费", "定义", "交付成果", "保密信息")
MORE_REFERENCES_ZH = ("附件", "验收标准", "本条", "上述", "服务费", "定义", "交付成果", "保密信息")


def reference_terms(before: Column, after: Column) -> Column:
    """The terms that a change names; if it names none of the first list, those of the second."""
    text = F.concat(F.coalesce(before, F.lit("")), F.coalesce(after, F.lit("")))
    of = lambda terms: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))
    return T.let(of(REFERENCES_ZH), lambda x: F.when(F.size(x) > 0, x).otherwise(of(MORE_REFERENCES_ZH)))


def references(segments: DataFrame, diffs: DataFrame, doc_col: str, k: int = 2) -> DataFrame:
    """The k best segments of each term that a difference (doc, diff_id, before, after) names, each text once."""
    q = diffs.select(doc_col, "diff_id", F.explode(F.array_distinct(reference_terms(F.col("before"), F.col("after")))).alias("query"))
    hits = context(segments, q.withColumn("query_id", F.concat_ws("|", F.col("diff_id").cast("string"), "query")), doc_col, k)
    once = F.row_number().over(Window.partitionBy("diff_id", "title", "text").orderBy("order"))
    return hits.withColumn("_n", once).where("_n = 1").select(doc_col, "diff_id", "query", "title", "text", "order")


def outline(segments: DataFrame, doc_col: str) -> DataFrame:
    """Distinct titles of each document with their place, in the order in which they first come."""
    first = segments.where(T.blank_to_null(F.col("title")).isNotNull()).groupBy(doc_col, "title").agg(F.min("order").alias("order"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(doc_col).orderBy("order")))


def overlap_weight(token: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.length(token), F.lit(8)) / 2)


def overlap_score(tokens: Column, text: Column) -> Column:
    """Sum over the tokens that text has, without white space, of max(1, min(length, 8) / 2)."""
    flat = T.flat(text)
    return T.let(flat, lambda x: F.aggregate(F.filter(tokens, lambda t: (t != "") & F.contains(x, t)), F.lit(0.0), lambda s, t: s + overlap_weight(t)))


#: Characters of the runs of a segment that its index holds: all of one to so many.
GRAM = 4


def context(segments: DataFrame, queries: DataFrame, doc_col: str, k: int = 4) -> DataFrame:
    """The k segments of each query's document with the highest positive overlap score, each text once.

    An index of the segments' short runs of characters is joined with the queries' tokens: a token of up to GRAM characters is a
    run itself, a longer one is looked for in the segments that hold its first GRAM. Segments that share nothing with a query never meet it.
    """
    asked = queries.select(doc_col, "query_id", F.explode(T.context_tokens(F.col("query"))).alias("token")).where("token <> ''")
    asked = asked.withColumn("run", F.substring("token", 1, GRAM))
    named = segments.select(doc_col, "order", T.flat(F.col("text")).alias("_flat"))
    wanted = asked.select(doc_col, "run").distinct()
    runs = named.select(doc_col, "order", F.explode(F.array_distinct(T.grams(F.col("_flat"), range(1, GRAM + 1)))).alias("run"))
    runs = _met(runs, wanted, [doc_col, "run"])
    met = _met(asked, runs, [doc_col, "run"])
    short = met.where(F.length("token") <= GRAM).select(doc_col, "query_id", "order", "token")
    long = _met(met.where(F.length("token") > GRAM), named, [doc_col, "order"]).where(F.contains("_flat", "token")).select(doc_col, "query_id", "order", "token")
    scored = short.unionByName(long).groupBy(doc_col, "query_id", "order").agg(F.sum(overlap_weight(F.col("token"))).alias("score"))
    scored = _met(_met(queries, scored, [doc_col, "query_id"]), segments, [doc_col, "order"])
    once = F.row_number().over(Window.partitionBy("query_id", "title", "text").orderBy("order"))
    best = scored.withColumn("_n", once).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "order"))).where(F.col("rank") <= k)


def context_pack(segments: DataFrame, diffs: DataFrame, doc_col: str, window: int = 1, related: int = 4, per_term: int = 2) -> DataFrame:
    """What a difference is read with: (doc, diff_id, part, place, order, title, text).

    segments: doc, order, title, text; diffs: doc, diff_id, review_module, before, after. part is `local` (the segments around that of either
    text), `related` (the best by overlap with the difference), `reference` (the best of each term that it names) or `outline` (the
    document's titles, for every difference; text is null). Each part has a segment once; place counts within the part, from 1.
    """
    texts = diffs.select(doc_col, "diff_id", F.explode(F.array("before", "after")).alias("wanted")).where(F.coalesce("wanted", F.lit("")) != "")
    texts = texts.withColumn("text_id", F.concat_ws("|", F.col("diff_id").cast("string"), F.sha2("wanted", 256))).dropDuplicates(["text_id"])
    hits = segment_of(texts, segments, doc_col).where("order IS NOT NULL").select(doc_col, "diff_id", "order")
    around = hits.select(doc_col, "diff_id", F.explode(F.sequence(F.col("order") - window, F.col("order") + window)).alias("order")).distinct()
    local = _met(around, segments, [doc_col, "order"]).withColumn("_by", F.col("order"))
    query = F.concat_ws(" ", F.coalesce("review_module", F.lit("")), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    near = context(segments, diffs.select(doc_col, F.col("diff_id").alias("query_id"), query.alias("query")), doc_col, related).withColumn("_by", F.col("rank")).withColumnRenamed("query_id", "diff_id")
    named = references(segments, diffs, doc_col, per_term).withColumn("_by", F.col("order"))
    titles = _met(diffs.select(doc_col, "diff_id"), outline(segments, doc_col), doc_col).withColumns({"_by": F.col("order"), "text": F.lit(None).cast("string")})
    parts = [df.select(doc_col, "diff_id", F.lit(name).alias("part"), "_by", "order", "title", "text") for name, df in (("local", local), ("related", near), ("reference", named), ("outline", titles))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    place = F.row_number().over(Window.partitionBy("diff_id", "part").orderBy("_by"))
    return every.withColumn("place", place).select(doc_col, "diff_id", "part", "place", "order", "title", "text")


def segment_of(texts: DataFrame, segments: DataFrame, doc_col: str) -> DataFrame:
    """texts (doc, text_id, wanted) with the order of the segment that is equal, else that holds it or is held; the first."""
    both = _met(texts, segments.select(doc_col, "order", F.col("text").alias("_s")), doc_col)
    tier = F.when(F.col("_s") == F.col("wanted"), 0).when(F.contains("_s", "wanted") | F.contains("wanted", "_s"), 1)
    found = both.withColumn("_r", F.struct(tier.alias("tier"), "order")).where("_r.tier IS NOT NULL").groupBy("text_id").agg(F.min("_r").alias("_r"))
    return _met(texts, found, "text_id", "left").select(*texts.columns, F.col("_r.order").alias("order"))
