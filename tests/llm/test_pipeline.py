import public_tokenizers
import tiktoken

import corpus_pipeline
from vellum.llm import quality_rules

from ..oracle import SMALL, rows_of_sql
from .brute import jaccard_components, mixed_documents, sha, uniform
from .test_text_ops import RANKS


def test_pipeline_equals_brute_force(spark):
    docs = dict(rows_of_sql("SELECT doc_id, text FROM documents", SMALL, ["doc_id", "text"]))
    kept = {r.doc_id for r in spark.createDataFrame(rows_of_sql(quality_rules.OP9_SQL, SMALL, sorted("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split())), sorted("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split())).where("kept").collect()}
    last = {}
    for i in sorted(kept):
        last[docs[i]] = i
    left = sorted(last.values())
    found = jaccard_components([(i, docs[i]) for i in left], 5, 80)
    left = [i for i in left if found[i][1] == i]
    rows = {r[0]: r for r in rows_of_sql("SELECT doc_id, lang, source, text FROM documents", SMALL, ["doc_id", "lang", "source", "text"])}
    drawn = mixed_documents([rows[i] for i in left], corpus_pipeline.MIXED_SHARE)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert all(x == (len(enc.encode_ordinary(docs[i])), sha(docs[i].encode())) for i, x in got.items())
    # a draw that lies within the rounding of its probability may go either way
    sure = {i for i, (_, p, _) in drawn.items() if abs(p - uniform(i)) > 1e-4}
    assert set(got) <= set(left) and set(got) & sure == {i for i in sure if drawn[i][2]}
    assert len(got) > 0.7 * len(left) and len(sure) > 0.9 * len(left)


def test_stages_return_the_columns_of_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "the cat is on the mat and it was as good as this for that of us in the end", "en", "a", 70), (2, "the cat is on the mat and it was as good as this for that of us in the end", None, None, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SMALL).columns == docs.columns
            stage(spark, df, SMALL).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SMALL).count() == df.count()
