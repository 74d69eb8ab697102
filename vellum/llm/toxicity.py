"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed lexicon and of a lexicon learned from the labelled rows,
hits near a second-person word, shares of capitals and punctuation, and rates of obfuscated words (letters
mixed with digits or symbols, hits only after undoing that, long repeats of one letter). Lexicon counts
stand beside densities so that one hit in a very long text is still seen. The trees (Spark ML) are fitted
on part of the labelled rows, the isotonic map from tree score to probability on the rest; the whole map is applied.

Bounds: FIT_ROWS labelled rows at most, drawn by a hash of the id. Scoring has no bound.

Defined results: a null or empty text has all features 0 and gets the score of such a text; rows are
scored alone, so ties and repeated rows change nothing; repeated labels of a row count each; labels that are
null are left out; labels of one class only give a constant score, that class's share (0 without any); an
empty table gives an empty result; other columns come through, but for one named score, which is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, packed, table
from .labelled import FIT_ROWS, calibrated, fit_sample, fold, isotonic

#: Insults of four languages.
LEXICON = frozenset(
    "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk imbecile "
    "dumm trottel abschaum versager widerlich idiota estúpido imbécil basura asqueroso inútil "
    "stupide imbécile ordure minable crétin débile".split()
)
#: Words of address.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tu usted ustedes vosotros".split())
#: Words each way in which a word of address counts as near.
NEAR = 4
#: Toxic documents that must have an entry of the learned lexicon, and its odds against other documents.
LEARNED_SUPPORT, LEARNED_ODDS = 8, 8.0
#: Lengths of word beginnings that the learned lexicon may hold beside whole words, for languages that inflect.
STEMS = (4, 5, 6)

_WORD = re.compile(r"[^\s]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][\d@$*!_.\-]+[^\W\d_]")
_RUN = re.compile(r"([^\W\d_])\1{3,}")
#: Look-alikes of letters; None: a mark put between letters.
_UNDO = {ord(k): v for k, v in {**dict(zip("013457@$!", "oieastasi", strict=True)), **dict.fromkeys("*_.-")}.items()}

FEATURES = (
    "hits", "hit_density", "learned_hits", "learned_density", "distinct_hits", "near_second_person", "second_person_density",
    "undone_hits", "mixed_rate", "run_rate", "capital_share", "capital_word_share", "punctuation_share", "shout_rate",
)


class Learned(dict):
    """Word -> whether it, or a beginning of it, is in the learned lexicon; remembers what it has met."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> bool:
        if len(self) >= 500_000:
            self.clear()
        self[word] = hit = word in self.lexicon or any(word[:k] + "-" in self.lexicon for k in STEMS if len(word) >= k)
        return hit


def features(text: str, learned: Learned) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    words = _LETTERS.findall(text.lower())
    n = max(1, len(words))
    places = [i for i, w in enumerate(words) if w in LEXICON]
    found = sum(map(learned.__getitem__, words))
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if places and second:
        at = set(second)
        near = sum(1 for i in places if any(j in at for j in range(i - NEAR, i + NEAR + 1)))
    mixed = _MIXED.findall(text)
    undone = 0
    if mixed:
        raw = [w for w in _WORD.findall(text.lower()) if _MIXED.search(w)]
        undone = sum(1 for w in raw if (u := w.strip(".,;:!?\"'()").translate(_UNDO)) in LEXICON and u not in w)
    letters = sum(map(len, words)) or 1
    capitals = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    loud = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b", text))
    marks = len(text) - len(re.sub(r"[^\w\s]", "", text))
    return [
        float(len(places)), len(places) / n, float(found), found / n, float(len({words[i] for i in places})), float(near), len(second) / n,
        float(undone), len(mixed) / n, len(_RUN.findall(text)) / n, capitals / letters, loud / n, marks / len(text), text.count("!") / n,
    ]


def feature_array(text: Column, learned: frozenset[str]) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Learned(learned)
        for batch in batches:
            yield batch.map(lambda t: features(t or "", known))

    return run(text)


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """Words, and beginnings of words (with a hyphen), LEARNED_ODDS times likelier in toxic documents of the bounded sample."""
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return frozenset()
    whole = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))
    stem = lambda k: F.transform(F.filter(whole, lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("-")))
    words = sample.select("label", F.explode(F.array_distinct(F.concat(whole, *[stem(k) for k in STEMS]))).alias("w"))
    counts = words.groupBy("w").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
    odds = ((F.col("bad") + 0.5) / bad) / ((F.col("good") + 0.5) / good)
    # as many as the bounded sample gives: each entry takes LEARNED_SUPPORT of its toxic documents
    return frozenset(r["w"] for r in counts.where((F.col("bad") >= LEARNED_SUPPORT) & (odds >= LEARNED_ODDS)).select("w").collect())


class Model:
    """Trees and the isotonic map, both over FEATURES; or a constant."""

    def __init__(self, learned, trees, steps, constant=0.0):
        self.learned, self.trees, self.steps, self.constant = learned, trees, steps, constant

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with a column score; docs has a column text."""
        rows = docs.select(packed(docs), F.col("text").alias("text"))
        if self.trees is None:
            return added(rows, {"score": F.lit(float(self.constant))}, docs.columns)
        x = rows.select("row", array_to_vector(feature_array(F.col("text"), self.learned)).alias("features"))
        raw = self.trees.transform(x).select("row", vector_to_array("probability")[1].alias("x"))
        return added(calibrated(raw, self.steps), {"score": F.col("calibrated")}, docs.columns)


#: Partitions of the rows that trees are fitted on.
FIT_PARTS = 8


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fitted on at most `rows` labelled rows: four fifths for the trees, one fifth for calibration."""
    sample = fit_sample(docs, labels, label, keep, rows).cache()
    try:
        calibrates = fold(F.col("doc_id"), 5) == 0
        parts = Counter({(r["c"], r["label"]): r["n"] for r in sample.groupBy(calibrates.alias("c"), "label").agg(F.count(F.lit(1)).alias("n")).collect()})
        bad, good = (parts[True, which] + parts[False, which] for which in (1, 0))
        if not parts[False, 0] or not parts[False, 1] or not parts[True, 0] + parts[True, 1]:
            return Model(frozenset(), None, None, bad / max(1, bad + good))
        learned = learn_lexicon(sample.where(~calibrates))
        x = sample.select(F.col("label").cast("double").alias("label"), calibrates.alias("calibrates"), array_to_vector(feature_array(F.col("text"), learned)).alias("features"))
        x = x.repartition(FIT_PARTS).cache()  # few numbers a row: dealt evenly, whatever the texts' partitions are like
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxDepth=3, maxIter=15, stepSize=0.3, seed=1).fit(x.where("NOT calibrates"))
        steps = isotonic(trees.transform(x.where("calibrates")).select(vector_to_array("probability")[1].alias("x"), "label"))
        x.unpersist()
        return Model(learned, trees, steps)
    finally:
        sample.unpersist()


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return model.score(docs).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
