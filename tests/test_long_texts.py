"""Long texts, whose short runs of characters cost no more than their length."""

import time

from pyspark.sql import functions as F
from vellum.functions import text as T
from vellum.plans import registry

from .test_hash_documents import vector
from .test_tokens import tokens

LONG = "".join(f"wort{i * i % 977} 合{i % 7} \U0001d4b3é\u3000\u2003 \n" for i in range(12000))


def seconds(df):
    start = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - start


def test_runs_of_characters_are_those_of_plain_python(spark):
    texts = ["", "a", "\U0001d4b3", "a\U0001d4b3", " \u3000x", "\n\n", LONG[:500]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.grams(F.col("text"), (1, 3, 2)).alias("g"), T.bm25_tokens(F.col("text")).alias("t"))
    for r in rows.collect():
        x = texts[r.id]
        assert r.g == [x[i : i + n] for n in (1, 3, 2) for i in range(len(x) - n + 1)]
        assert r.t == tokens(x)


def test_tokens_of_a_text_of_eight_times_the_length(spark):
    """Time grew with the square of the length; one core, after a first run."""
    short, long = (spark.createDataFrame([(LONG[: len(LONG) * k // 8],)], "text string").select(T.bm25_tokens(F.col("text")).alias("t")) for k in (1, 8))
    seconds(short)
    seconds(long)
    assert seconds(long) < 24 * max(seconds(short), 0.05)


def test_vectors_of_long_texts_of_one_id(spark, tmp_path):
    """Longer than one piece of counting, and an id of two rows."""
    docs = [(1, LONG * 3), (2, "one"), (2, "two\u3000ONE")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    df = registry.QUERIES["hash_embedding_documents"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "token" not in plan  # vectors move, not their tokens
    for r in df.collect():
        found.setdefault(r.doc_id, {})[r.slot] = r.weight
    assert found[1] == {s: w for s, (w, _) in vector(LONG * 3).items()}
    both = {}
    for t in ("one", "two\u3000ONE"):
        for s, (w, _) in vector(t).items():
            both[s] = both.get(s, 0) + w
    assert found[2] == {s: w for s, w in both.items() if w}


def test_long_versions_with_the_same_sentences(spark):
    """Sentences whose equal is free are looked up; those without one are compared with all that are free."""
    from vellum.operators import diff

    sentences = ["".join(chr(97 + (i >> b & 1) * 13 + b) for b in range(13)) for i in range(2000)]
    df = spark.createDataFrame([(1, sentences, sentences[:1000] + ["字"] + sentences[1000:])], "pair_id int, old_sentences array<string>, new_sentences array<string>")
    got = [(r.change_type, r.old_index, r.new_index, r.similarity) for r in diff.sentence_diff(df).orderBy("diff_index").collect()]
    assert got == [("modified", i, i + (i >= 1000), 1.0) for i in range(1000)] + [("added", None, 1000, 0.0)] + [("modified", i, i + 1, 1.0) for i in range(1000, 2000)]
