import random

from vellum.operators import versions
from vellum.plans import documents


def brute(texts, similar=versions.SIMILAR):
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        if w:
            sets[i] = {" ".join(w[k : k + versions.WORDS]) for k in range(max(1, len(w) - versions.WORDS + 1))}
    near = lambda a, b: len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]) - 1e-9
    return {i: max(old) for i in sets if (old := [j for j in sets if j < i and near(i, j)])}


def corpus():
    r = random.Random(3)
    texts = {0: None, 1: "", 2: "short", 3: "short", 4: "two words", 5: "two words"}
    for base in range(40):
        words = [r.choice("abcdefghijkl") * r.randint(1, 3) for _ in range(r.randint(20, 80))]
        for _ in range(6):
            w = list(words)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = "changed"
            texts[len(texts)] = " ".join([f"opening{r.randint(0, 2)} of every such text here, always alike"] * r.randint(0, 1) + w)
    return texts


def test_versions_equal_brute_force(spark):
    texts = corpus()
    found = versions.version_ids(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = brute(texts)
    assert len(want) > 30 and {r.doc_id: r.old_id for r in found} == want


def test_version_pairs_of_whole_texts(spark, tmp_path):
    tail = " ".join(f"word{i}" for i in range(80))
    head = "the same forty characters open this text and"
    rows = [(1, f"first opening {tail}"), (2, f"another opening {tail}"), (3, f"{head} one two three four"), (4, f"{head} {' '.join(f'other{i}' for i in range(40))}"), (5, "tiny text"), (6, "tiny text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.pair_id, r.old) for r in documents._versions(spark, str(tmp_path)).collect()) == [(2, rows[0][1]), (6, "tiny text")]


def test_only_the_nearest_candidates_are_compared(spark, monkeypatch):
    """Of near-duplicates of one text, each is compared with a few before it, and with all of those only if none of them is a version."""
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(words[:50] + [f"own{i}"] + words[50:]) for i in range(40)}
    texts |= {100 + i: " ".join(words[i : i + 34]) for i in range(12)} | {200: texts[3], 201: texts[3], 202: " ".join(words[:58])}
    compared = []
    near = versions.near
    monkeypatch.setattr(versions, "near", lambda sets, pairs, similar: compared.append(pairs.count()) or near(sets, pairs, similar))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for nearest in (1, 4):
        compared.clear()
        assert {r.doc_id: r.old_id for r in versions.version_ids(df, nearest=nearest).collect()} == brute(texts)
        assert compared[0] <= nearest * len(texts) and sum(compared) < 6 * len(texts)
