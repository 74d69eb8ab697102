from pyspark.sql import functions as F
from vellum.functions import text as T
from vellum.plans import registry

from .oracle import SMALL


def test_characters_are_told_apart_before_texts_meet(spark):
    plan = registry.QUERIES["jaccard_sentences"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    head = plan.split("Generate inline")[0]
    assert "array_intersect" in head and "split(" not in head


def test_sets_give_what_texts_give(spark):
    texts = ["", "a", "abc", "cab", "\u5408\u540cab", None, "  "]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select(T.char_jaccard(F.col("a"), F.col("b")).alias("x"), T.set_jaccard(T.chars(F.col("a")), T.chars(F.col("b"))).alias("y")).collect():
        assert r.x == r.y
