"""Queries that SQL can't express, held against plain Python over the smallest tables."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F
from vellum.functions import text as T
from vellum.operators import diff, redact, segment
from vellum.plans import registry

from .oracle import SMALL, rows_of_sql
from .test_operators import plainly_redacted
from .test_versions import brute

ENDS = ".!?\n"


def documents():
    return dict(rows_of_sql("SELECT doc_id, text FROM documents", SMALL, ["doc_id", "text"]))


def sentences(text):
    return [x for s in re.split(rf"(?<=[{re.escape(ENDS)}])\s*", text) if (x := s.strip())]


def matched(old, new, threshold=0.6):
    """(kind, old place, new place): each new sentence takes the most similar free old one."""
    free, out = list(range(len(old))), []
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    for i, s in enumerate(new):
        best = max(((like(old[j], s), -j) for j in free), default=(0.0, 0))
        if best[0] >= threshold:
            free.remove(-best[1])
            out.append(("modified", -best[1], i))
        else:
            out.append(("added", None, i))
    return out + [("deleted", j, None) for j in free]


def test_redaction_of_documents(spark):
    import hashlib

    docs = documents()
    for r in registry.QUERIES["redact_reversible"](spark, SMALL).collect():
        text, mappings = plainly_redacted(docs[r.doc_id], redact.PATTERNS_LATIN)
        assert (r.sanitized_sha256, r.n_mappings, r.round_trip) == (hashlib.sha256(text.encode()).hexdigest(), len(mappings), True)


def test_sentence_differences_of_versions(spark):
    docs = documents()
    pairs = brute(docs)
    want = {i: matched(sentences(docs[old]), sentences(docs[i])) for i, old in pairs.items()}
    got = {}
    for r in registry.QUERIES["sentence_diff"](spark, SMALL).orderBy("pair_id", "diff_index").collect():
        got.setdefault(r.pair_id, []).append((r.change_type, r.old_index, r.new_index))
    assert got == {i: d for i, d in want.items() if d} and len(got) > 10
    for r in registry.QUERIES["diff_stats"](spark, SMALL).collect():
        kinds = Counter(d[0] for d in want[r.pair_id])
        assert (r.total, r.added, r.deleted, r.modified, r.unchanged) == (len(want[r.pair_id]), kinds["added"], kinds["deleted"], kinds["modified"], 0)


def clause_changes(before, after):
    """[(kind, place before, place after)] by difflib's blocks, a plain search for the likest clause, and a plain search for moves."""
    like = lambda x, y: SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else float(x == y)
    pairs, gone, come = [], [], []
    for tag, i, j, k, m in SequenceMatcher(None, before, after, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        left = list(range(k, m))
        for x in range(i, j):
            scores = [like(before[x], after[y]) for y in left] if tag == "replace" else []
            if scores and max(scores) >= 0.22:
                y = left.pop(scores.index(max(scores)))
                pairs.append(("moved" if before[x] == after[y] else "changed", x, y))
            else:
                gone.append(x)
        come += left
    deleted = []
    for x in gone:
        scores = [like(before[x], after[y]) for y in come]
        if scores and max(scores) >= 0.92:
            pairs.append(("moved", x, come.pop(scores.index(max(scores)))))
        else:
            deleted.append(("deleted", x, None))
    return pairs + deleted + [("added", None, y) for y in come]


def test_clause_differences_equal_difflib(spark):
    """Over the version pairs of the table, and over versions whose clauses were dealt anew, so that some move."""
    docs = documents()
    r = random.Random(3)
    texts = [(i, docs[old], docs[i]) for i, old in brute(docs).items()]
    words = "pay deliver court term notice fee supplier buyer accept refuse".split()
    for k in range(40):
        old = [" ".join(r.choice(words) for _ in range(r.randint(4, 12))) for _ in range(r.randint(2, 14))]
        new = [x if r.random() < 0.7 else x + " " + r.choice(words) for x in old if r.random() < 0.9]
        for _ in range(r.randint(0, 3)):
            new.insert(r.randint(0, len(new)), new.pop(r.randrange(len(new))) if new else "all new")
        texts.append((100_000 + k, "\n".join(x + "。" for x in old), "\n".join(x + "。" for x in new)))
    df = spark.createDataFrame(texts, "pair_id long, old string, new string")
    sides = [segment.clauses(df.select("pair_id", F.translate(c, ".", "。").alias("t")), "pair_id", "t") for c in ("old", "new")]
    cut = []
    for side in sides:
        cut.append({})
        for x in side.orderBy("pair_id", "order").collect():
            cut[-1].setdefault(x.pair_id, []).append((x.text, x.normalized))
    got, kinds = {}, Counter()
    for x in diff.clause_diff(*sides).collect():
        got.setdefault(x.pair_id, []).append((int(x.diff_id.rsplit("-", 1)[1]), x.change_type, x.before, x.after))
        kinds[x.change_type] += 1
    for i, _, _ in texts:
        b, a = cut[0].get(i, []), cut[1].get(i, [])
        found = clause_changes([x for _, x in b], [x for _, x in a])
        want = [(n + 1, kind, "" if x is None else b[x][0], "" if y is None else a[y][0]) for n, (kind, x, y) in enumerate(found)]
        assert sorted(got.get(i, [])) == want, i
    assert min(kinds[k] for k in ("moved", "changed", "added", "deleted")) >= 10


def test_clause_diff_moves_query_is_that_of_its_versions(spark):
    docs = documents()
    pairs = brute(docs)
    rows = registry.QUERIES["clause_diff_moves"](spark, SMALL).collect()
    df = spark.createDataFrame([(i, docs[old], docs[i]) for i, old in pairs.items()], "pair_id long, old string, new string")
    sides = [segment.clauses(df.select("pair_id", F.translate(c, ".", "。").alias("t")), "pair_id", "t") for c in ("old", "new")]
    want = {(x.diff_id, x.change_type, x.before, x.after) for x in diff.clause_diff(*sides).collect()}
    assert {(x.diff_id, x.change_type, x.before, x.after) for x in rows} == want and len(rows) == len(want)
    # whether a change counts, by the words and numbers of both sides
    for x in rows:
        text = x.before + x.after
        if not any(w in text for w in diff.SUBSTANTIVE_ZH) or x.change_type == "moved":
            assert not x.is_substantive
        elif not x.before or not x.after:
            assert x.is_substantive


def test_quotes_of_documents(spark):
    """Each quote's best sentence by the three tiers."""
    docs = documents()
    items = dict(rows_of_sql("SELECT item_id, text FROM benchmark", SMALL, ["item_id", "text"]))
    tiers = Counter()
    clean = lambda s: set(re.sub(r"[^\w一-鿿]", "", s.lower()))
    got = {r.doc_id: (r.sentence_index, r.tier, r.score) for r in registry.QUERIES["evidence_sentence"](spark, SMALL).collect()}
    for i, text in docs.items():
        paras = [p for line in (text or "").split("\n") if (p := line.strip())]
        sents = [s for p in paras for s in re.findall(r"[^.!?]+[.!?]*", p)]
        if i % 2 == 0:
            quote = max(paras, key=len)[:60].strip() if paras else ""
        else:
            quote = (items.get(i % 40) or "").strip()
        want = None
        if quote and sents:
            words = [w for x in re.split("[，。！？；：、'\" （）]", quote) if len(w := x.strip()) >= 2 and w not in T.STOP_WORDS_ZH][:5]
            inside = [(2.0 if len(quote) <= len(s) else 1.5) if quote in s or s in quote else 0.0 for s in sents]
            hits = [float(sum(w in s for w in words)) for s in sents]
            like = [len(clean(quote) & clean(s)) / len(clean(quote) | clean(s)) if clean(quote) and clean(s) else 0.0 for s in sents]
            for name, scores, least in (("containment", inside, 1), ("keywords", hits, 1), ("similarity", like, 0.3)):
                if max(scores) >= least:
                    want = (scores.index(max(scores)) + 1, name, max(scores))
                    break
        assert got.get(i) == want, (i, quote)
        tiers[want and want[1]] += 1
    assert tiers["containment"] > 50 and tiers["keywords"] > 5
