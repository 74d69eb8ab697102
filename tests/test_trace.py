"""Diagnostics of traces: their plan, and odd rows held against a plain loop."""

from vellum.operators import scoring
from vellum.plans import registry

from .oracle import SMALL

SAMPLES = ["a", "b", "c", None, "a"]
DIFFS = [
    ("a", 1, "Pay", "added", "x", "付款 甲方", False), ("a", 2, "PAY", "modified", None, "付款 合同", True), ("a", 3, "Term", "added", "q", None, False), ("a", 3, "Term", "added", "q", None, None),
    ("b", 4, "Term", "deleted", None, None, False), ("b", 5, None, None, "", "付款", True), (None, 6, "Pay", "added", "x", "付款", False), ("d", 7, "Pay", "added", "x", "付款", False),
]
EXPECTED = [
    ("a", 10, ["pay", "PAY", "term"], None, ["付款"]), ("a", 10, ["pay"], "added", ["甲方"]), ("a", 11, ["Pay"], "deleted", ["付款"]), ("a", None, ["pay"], None, ["付款"]), ("a", 12, ["term"], "added", None),
    ("a", 13, None, None, []), ("b", 10, ["term"], None, ["付款", "合同"]), ("b", 14, ["term"], None, []), (None, 15, ["pay"], None, []),
]
RULES = [
    ("a", 20, "d", "x", "y", True), ("a", 20, "", "q", None, None), ("a", 21, None, None, "no", False), ("a", None, "d", "x", "x", True), ("b", 22, "d", "x", "q", True), (None, 23, "d", "x", "q", True), ("c", 24, "", "x", "q", True),
]


def plain():
    for sample in SAMPLES:
        own = lambda rows: [r for r in rows if sample is not None and r[0] == sample]  # noqa: B023, E731
        diffs, expected, rules = own(DIFFS), own(EXPECTED), own(RULES)
        texts = [(str(d[2]).lower(), d[3], f"{d[4] or ''}\n{d[5] or ''}") for d in diffs if d[2] is not None]
        share = lambda text, words: sum(w in text for w in words) / len(words) if words else 1.0
        meets = lambda e, d: d[0] in [m.lower() for m in e[2] or []] and (e[3] is None or e[3] == d[1]) and share(d[2], e[4] or []) >= 0.6
        covered = {e[1] for e in expected if any(meets(e, d) for d in texts)} - {None}
        wanted = {e[1] for e in expected} - {None}
        noop = [d for d in diffs if d[6] is False]
        told = lambda r: "\n".join(x for x in r[3:5] if x is not None)
        pointed = {r[1] for r in rules if any(x is not None and x in told(r) for d in noop for x in d[4:6])} - {None}
        n, some = len(rules), sum(d[6] is True for d in diffs)
        over = lambda a, b, empty: round(a / b, 6) if b else empty
        yield (sample, len(diffs), some, over(len(covered), len(wanted), 1.0), round(1 - (len(pointed) / len(noop) if noop else 0.0), 6), over(n, some, 0.0), over(sum(r[5] is True for r in rules), n, 0.0), over(sum(bool(r[2]) for r in rules), n, 0.0))


def test_odd_rows(spark):
    got = scoring.trace_diagnostics(
        spark.createDataFrame([(s,) for s in SAMPLES], "sample_id string"), spark.createDataFrame(DIFFS, "sample_id string, diff_id long, review_module string, change_type string, before string, after string, is_substantive boolean"),
        spark.createDataFrame(EXPECTED, "sample_id string, rule_id long, modules array<string>, change_type string, keywords array<string>"),
        spark.createDataFrame(RULES, "sample_id string, rule_id long, source_diff_id string, evidence_before string, evidence_after string, valid boolean"),
    ).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(), key=str)


def test_parts_are_summed_once_and_pairs_are_not_listed(spark):
    plan = registry.QUERIES["trace_diagnostics"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"Join {kind}") for kind in ("LeftOuter", "LeftSemi", "Inner")] == [1, 2, 0]
