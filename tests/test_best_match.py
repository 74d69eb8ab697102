from vellum.plans import registry


def test_items_meet_all_sentences_of_documents(spark, tmp_path):
    items = {20: "abcdef", 21: "not asked", 40: "xyz xyz", 60: ""}
    docs = {1: "abc. abcdeg! zz\nabcdef", 2: "xyzzy. x yz", 3: None}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sentences = [(r.doc_id, r.paragraph_index, r.sentence_in_paragraph, r.text) for r in registry.QUERIES["doc_sentences"](spark, str(tmp_path)).collect()]
    assert len(sentences) == 6
    jaccard = lambda a, b: round(len(set(a) & set(b)) / len(set(a) | set(b)), 6) if a and b else 0.0
    want = {(i, *s[:3]): jaccard(t, s[3]) for i, t in items.items() if i % 20 == 0 for s in sentences}
    assert {tuple(r)[:4]: r.similarity for r in registry.QUERIES["jaccard_sentences"](spark, str(tmp_path)).collect()} == want
    best = {i: min((-x, k[1:]) for k, x in want.items() if k[0] == i) for i in (20, 40, 60)}
    assert {r.item_id: (-r.similarity, tuple(r)[1:4]) for r in registry.QUERIES["best_match"](spark, str(tmp_path)).collect()} == best
