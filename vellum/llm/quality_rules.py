"""Quality rules as one projection: a table of thresholds compiled into Spark expressions.

Every metric and every verdict is a built-in function inside one select, so a document is read
once and nothing is shuffled. Bounds are exact: a ratio num/den <= b/1000 is tested as
1000 * num <= b * den.

Defined results: a null or empty text has no words and fails (n_words < 20); rows are judged alone,
so ties and repeated rows change nothing; an empty table gives an empty result; columns of the
input other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, table

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the a an and of to in is it that for on with as was are be this by at or from have not "
    "der die das und ist von mit zu den ein eine nicht auf sich im dem des für "
    "le la les de du des et un une est que qui pour dans en par sur au aux avec "
    "el los las y del que se con una por su para es al lo como"
).split()

#: (metric, of, least per mille or None, most per mille or None)
THRESHOLDS = (
    ("word_chars", "n_words", 2_000, 15_000),
    ("n_symbols", "n_words", None, 100),
    ("n_shouts", "n_words", None, 300),
    ("n_stop_words", "n_words", 20, None),
    ("n_dup_lines", "n_lines", None, 400),
    ("longest_word", "one", None, 1_000_000),
)

WINDOW = 8


def _repeated(words: Column, n: int = WINDOW) -> Column:
    """Words inside n-word windows that occur twice or more among words.

    Windows are compared by hash; sorting (hash, place) puts equal windows side by side, so the cost
    is n log n in the document's length, also for a document that repeats one window throughout.
    """
    size = F.size(words)

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            hits = F.filter(s, lambda x, j: same(F.get(s, j - 1), x) | same(F.get(s, j + 1), x))
            return F.array_sort(F.transform(hits, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, i: F.struct((i + n).alias("end"), (acc["n"] + (i + n - F.greatest(i, acc["end"])).cast("long")).alias("n"))
        return F.aggregate(let(pairs, places), start, add, lambda acc: acc["n"])

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered(windows)).otherwise(F.lit(0).cast("long"))

    def hashed(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, n)))
        return let(windows, counted)

    return F.when(size <= n, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def metrics(text: Column) -> Column:
    """The struct of counts that the rules are about."""
    text = F.coalesce(text, F.lit(""))
    lacks = lambda p: (F.length(text) - F.length(F.regexp_replace(text, p, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    stops = [F.lit(x) for x in dict.fromkeys(STOP_WORDS)]

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            lacks(r"[#*$%&|<>]+").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeated(words).alias("n_repeat_words"),
            lacks("!+").alias("n_shouts"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*stops))).cast("long").alias("n_stop_words"),
            F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)).cast("long").alias("longest_word"),
        )

    return let(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""), of_words)


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """The table as one boolean: no rule broken. A ratio over nothing breaks no rule."""
    ok = F.lit(True)
    for metric, of, least, most in thresholds:
        num, den = F.col(metric), F.lit(1) if of == "one" else F.col(of)
        if least is not None:
            ok = ok & ((num * 1000 >= den * least) | (den == 0))
        if most is not None:
            ok = ok & ((num * 1000 <= den * most) | (den == 0))
    return ok


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row a document: its counts, base_failed and kept."""
    m = docs.select(F.col(f"`{id_col}`").alias("doc_id"), metrics(F.col(f"`{text_col}`")).alias("m"))
    m = m.select("doc_id", "m.*").select("*", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines")).drop("lines")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(thresholds))


def quality_filter(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The documents that keep all rules, with the columns they came with."""
    m = metrics(F.col(f"`{text_col}`"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), m.alias("m")).select("row", "m.*")
    row = row.select("*", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return row.where(~failed & compile_rules(thresholds)).select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS_SQL = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i+7], ' ') AS k FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
dup AS (SELECT r, k FROM win GROUP BY r, k HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT win.r, unnest(range(i, i + 8)) AS p FROM win JOIN dup ON win.r = dup.r AND win.k = dup.k) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS n_shouts,
             len(list_filter(words, lambda x: lower(x) IN ({_STOPS_SQL}))) AS n_stop_words,
             coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest_word
      FROM w LEFT JOIN cov ON w.r = cov.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words AND 10 * n_shouts <= 3 * n_words
       AND 50 * n_stop_words >= n_words AND 5 * n_dup_lines <= 2 * n_lines AND longest_word <= 1000 AS kept
FROM f
"""
