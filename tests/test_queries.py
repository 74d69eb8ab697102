import pytest
from vellum.plans import registry

from .oracle import SMALL, same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same(registry.QUERIES[name](spark, SMALL), registry.ORACLES[name], SMALL)


#: Queries that SQL can't express, or not fast enough: where they are held against plain Python.
ELSEWHERE = {
    "redact_reversible": "test_plain", "sentence_diff": "test_plain", "diff_stats": "test_plain", "clause_diff_moves": "test_plain", "evidence_sentence": "test_plain", "jaccard_sentences": "test_best_match", "best_match": "test_best_match",
    "bm25_topk_tokens": "test_tokens", "hybrid_fusion_tokens": "test_tokens", "tiered_retrieval_tokens": "test_tokens", "hash_embedding_documents": "test_hash_documents", "redacted_differences": "test_small",
}


def test_every_query_is_held_against_something():
    import importlib
    import inspect

    assert set(registry.QUERIES) - set(registry.ORACLES) == set(ELSEWHERE)
    for name, module in ELSEWHERE.items():
        assert name in inspect.getsource(importlib.import_module(f"tests.{module}"))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_llm_is_imported_by_nothing_else():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "vellum"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["rule_snapshot"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "p_retailprice" not in plan.split("== Physical Plan ==")[1]
