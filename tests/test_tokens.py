import math
import random
import re
from collections import Counter

from vellum.plans import registry


def tokens(text):
    pairs = [text[i : i + 2] for i in range(len(text) - 1)]
    return re.findall(r"[一-鿿]+|[a-z0-9]+", text.lower()) + [p for p in pairs if p.strip()]


ITEMS = {20: "合同 付款", 21: "not asked", 40: "schöne Größe", 60: "plain words"}
DOCS = {1: "付款合同", 2: "合同 违约", 3: "die Größe zählt", 4: "schön plain", 5: "other words here", 6: None, 7: "nothing of it", 8: "zzz", 9: "qqq 12"}
LANG = {i: "de" if i in (3, 4) else "es" if i in (2, 5, 8) else "en" for i in DOCS}
SOURCE = {i: "src40" if i == 2 else "src20" if i == 5 else "src1" for i in DOCS}


def tables(spark, path):
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = [(i, t, LANG[i], SOURCE[i]) for i, t in DOCS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    r = random.Random(4)
    vectors = {i: [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)] for i in range(61)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return vectors


def bm25():
    """{query: {document: score}}"""
    tk = {i: tokens(t or "") for i, t in DOCS.items()}
    n, avg = len(tk), sum(map(len, tk.values())) / len(tk)
    df = Counter(t for x in tk.values() for t in set(x))
    raw = {t: math.log((n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    out = {}
    for q in (20, 40, 60):
        out[q] = Counter()
        for t, times in Counter(tokens(ITEMS[q])).items():
            for i, x in tk.items():
                if tf := x.count(t):
                    out[q][i] += times * idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / avg))
    return out


def best(scores, k):
    return sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:k]


def test_bm25_over_all_tokens_equals_brute_force(spark, tmp_path):
    tables(spark, tmp_path)
    want = {(q, i, k + 1) for q, scores in bm25().items() for k, i in enumerate(best(scores, 5))}
    assert {(20, 1, 1), (40, 3, 1)} & {(q, i, 1) for q, i, _ in want}
    assert {tuple(r) for r in registry.QUERIES["bm25_topk_tokens"](spark, str(tmp_path)).collect()} == want


def test_fusion_over_all_tokens_equals_brute_force(spark, tmp_path):
    vectors = tables(spark, tmp_path)
    terms, want = bm25(), set()
    for q in (0, 20, 40, 60):
        dot = {i: round(sum(a * b for a, b in zip(vectors[q], v, strict=True)), 9) for i, v in vectors.items()}
        near = {i: dot[i] for i in sorted(dot, key=lambda i: (-dot[i], i))[:100]}
        own = {i: max(0.0, s) for i, s in terms.get(q, {}).items()}
        top = max(own.values(), default=0.0)
        fused = {i: 0.6 * near.get(i, 0.0) + 0.4 * (own.get(i, 0.0) / top if top > 0 else own.get(i, 0.0)) for i in {*near, *own}}
        if q % 40 == 0 and any(LANG.get(i) == "de" for i in fused):
            fused = {i: s for i, s in fused.items() if LANG.get(i) == "de"}
        want |= {(q, i, k + 1) for k, i in enumerate(best(fused, 10))}
    assert {tuple(r) for r in registry.QUERIES["hybrid_fusion_tokens"](spark, str(tmp_path)).collect()} == want
    assert sum(q == 40 for q, _, _ in want) == 2 and sum(q == 20 for q, _, _ in want) == 10


def test_tiers_over_all_tokens_equal_brute_force(spark, tmp_path):
    tables(spark, tmp_path)
    want = set()
    for q, scores in bm25().items():
        fits = [lambda i: LANG[i] == "es" and SOURCE[i] == f"src{q}", lambda i: LANG[i] == "es", lambda i: True]  # noqa: B023
        tier = next((t for t, f in enumerate(fits) if any(map(f, scores))), None)
        found = best({i: s for i, s in scores.items() if fits[tier](i)}, 3) if tier is not None else []
        want |= {(q, i, tier, k + 1, round(1 - k / max(len(found), 10), 4)) for k, i in enumerate(found)}
    got = {(r.query_id, r.doc_id, r.tier, r.rank, r.score) for r in registry.QUERIES["tiered_retrieval_tokens"](spark, str(tmp_path)).collect()}
    assert got == want and len({t for _, _, t, _, _ in want}) > 1
