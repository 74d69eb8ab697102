from vellum.plans import registry

from .oracle import SMALL


def test_a_pack_broadcasts_nothing(spark):
    """All its sides grow with the documents."""
    plan = registry.QUERIES["context_pack"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_evidence_is_taken_apart_before_it_meets_sentences(spark):
    from vellum.operators import locate

    evidence = spark.createDataFrame([(1, 1, "Late Fee")], "doc_id long, evidence_id long, evidence string")
    sents = spark.createDataFrame([(1, 1, "no match"), (1, 2, "fee, late")], "doc_id long, sentence_index int, text string")
    found = locate.best_sentence(evidence, sents)
    assert [(r.sentence_index, r.tier) for r in found.collect()] == [(2, "similarity")]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "lower(text" in above.replace("s_text", "text") and "lower(evidence" not in above
