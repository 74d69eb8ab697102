import hashlib
import re
from collections import Counter

from vellum.plans import registry


def vector(text):
    t = text.lower()
    u = re.sub(r"\s+", "", t)
    slots = Counter()
    for token in re.findall(r"[a-z0-9_]+", t) + [u[i : i + n] for n in (1, 2, 3, 4) for i in range(len(u) - n + 1)]:
        d = hashlib.md5(token.encode()).digest()
        slots[int.from_bytes(d[:4], "big") % 512] += 1 if d[4] % 2 == 0 else -1
    kept = {s: w for s, w in slots.items() if w}
    return {s: (w, round(w / sum(x * x for x in kept.values()) ** 0.5, 9)) for s, w in kept.items()}


def test_every_document_is_embedded(spark, tmp_path):
    docs = {1: "Some words, some WORDS\nof a text", 2: "合同 付款 Größe", 3: "", 4: None, 5: "long " * 300 + "tail"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in registry.QUERIES["hash_embedding_documents"](spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, {})[r.slot] = (r.weight, r.value)
    want = {i: v for i, t in docs.items() if (v := vector(t or ""))}
    assert {i: {s: w for s, (w, _) in v.items()} for i, v in found.items()} == {i: {s: w for s, (w, _) in v.items()} for i, v in want.items()}
    assert all(abs(found[i][s][1] - x) < 2e-9 for i, v in want.items() for s, (_, x) in v.items())
