import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from vellum.llm import bpe, compression_quality, mixing, pii, quality_rules, toxicity, warc_revisits
from vellum.llm.labelled import calibrated
from vellum.llm.queries import QUERIES

from ..oracle import SMALL, rows_of_sql

from .brute import disclosing_terms, identifiers, mixed_documents, sha, term_spans, uniform

DOCS = "doc_id long, text string"
LARGER = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def ids(packed):
    return [x for (x,) in struct.iter_unpack("<I", packed)]


# --- BPE ------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_bpe_equals_tiktoken(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(ENCODER.encode(text)) == TIKTOKEN.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 50_000, "abcdefgh" * 8_000, " \n" * 70_000, "word " * 80_000, ""])
def test_bpe_long_texts(text):
    assert ids(ENCODER.encode(text)) == TIKTOKEN.encode_ordinary(text)


def test_bpe_random_pre_tokens():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(1, 300)))
        assert ids(ENCODER.encode(text)) == TIKTOKEN.encode_ordinary(text)


def test_bpe_round_trip_keeps_columns(spark):
    df = spark.createDataFrame([(1, "héllo  wörld\n", "x"), (1, None, None), (None, "", "y")], DOCS + ", decoded_at string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert out.columns == [*df.columns, "ids", "decoded"]
    assert [bytes(r.decoded) for r in out.collect()] == [(r.text or "").encode() for r in df.collect()]
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_replaces_columns_of_its_names(spark):
    rows = [(1, "a\0b \xe9", b"x", 1), (2, "same", b"y", 2), (2, "same", b"y", 2)]
    df = spark.createDataFrame(rows, DOCS + ", ids binary, Decoded int")
    out = bpe.encode_decode(df, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert [bytes(r.decoded).decode() for r in out.collect()] == [r[1] for r in rows]


def test_bpe_memory_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    small, r = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(200):
        text = " ".join(r.choice(["one", "twoo", "threee", "xqzw", "qqqv", "zzkj", "jjvx", "wwwq"]) for _ in range(9))
        assert ids(small.encode(text)) == TIKTOKEN.encode_ordinary(text) and len(small) <= 5


def test_bpe_query(spark):
    texts = dict(rows_of_sql("SELECT doc_id, text FROM documents", SMALL, ["doc_id", "text"]))
    for r in QUERIES["op4_byte_bpe"](spark, SMALL).collect():
        want = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(struct.pack(f"<{len(want)}I", *want)), sha(texts[r.doc_id].encode()))


# --- quality rules --------------------------------------------------------------------------------


def test_quality_rules_edges(spark):
    good = "the end of this is as it was and that is for the best with you at home in a house"
    rows = [(1, None), (2, ""), (3, "one two"), (4, good), (5, "a b c d e f g h " * 5_000), (6, (good + "\n") * 3), (7, "x!! " * 40), (None, good)]
    df = spark.createDataFrame(rows, DOCS).withColumn("m", F.lit(1)).withColumn("n_lines", F.lit(9))
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False)
    assert got[4].kept and got[None].kept and not got[3].kept
    assert (got[5].n_words, got[5].n_repeat_words) == (40_000, 40_000)
    assert got[6].n_dup_lines == 2 and got[6].n_repeat_words == got[6].n_words
    assert sorted(r.doc_id or 0 for r in quality_rules.quality_filter(df).collect()) == [0, 4]
    assert quality_rules.quality_filter(df).columns == df.columns
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


# --- PII ------------------------------------------------------------------------------------------

FRAGMENTS = ["4111 1111 1111 1111", "4111111111111111", "1-2-3", "12 34", "a@b.c_d@e.f", "x.y@z", "q@w.e.r-", "1.2.3.4.5.6.7.8", "999.1.1.1", "00255.1.1.1", "+1 (555) 123-4567", "+1", "+12", "++49 30 1234567", " ", "-", ".", "é😀", "\n", "0", "7" * 25, "@", "word", "4111-1111-1111-1111-"]


def test_pii_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    docs = {i: "".join(r.choice(FRAGMENTS) for _ in range(r.randint(0, 25))) for i in range(400)} | {500: None, 501: "1" * 3_000 + "a" * 3_000 + "@", 502: "1 " * 3_000, 503: "+1 " * 3_000}
    spark.createDataFrame(list(docs.items()), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for row in QUERIES["op8_pii"](spark, str(tmp_path)).collect():
        want = identifiers(docs[row.doc_id])
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert row.base_sha256 == sha(told.encode())
        assert set(told.split(",")) - {""} <= set(row.spans.split(","))


def spans_of(df):
    return {r.doc_id: r.s for r in pii.find_pii(df).select("doc_id", pii.span_list(F.col("all")).alias("s")).collect()}


def test_pii_disclosing_terms(spark):
    rows = [(i, f"secretword alpha@b.com plus {i}") for i in range(5)] + [(7, "no such person near the place"), (None, None), (8, "plain text"), (8, "plain text"), *((i, f"other {i}") for i in range(20, 200))]
    df = spark.createDataFrame(rows, DOCS).withColumn("base", F.lit(1))
    found = spans_of(df)
    assert found[1] == "term:0:10,email:11:22,term:23:27" and found[7] == found[None] == found[8] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[2] == " [EMAIL]  2" and clean[7] == "no such person near the place" and clean[None] == ""
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_terms_of_rare_identifiers(spark):
    far = " and so it went on" * 40
    rows = [*((i, f"Li{far} {i} a@b.com") for i in range(100, 108)), *((i, f"Studio54{far} 12.3.4.5 studio54 {i}") for i in range(200, 204)), *((i, f"plain and so it went on x{i}") for i in range(1000, 2000))]
    # seen beside an identifier once, or in copies of one text only: no ground to judge by
    rows += [(1, f"wombat{far} 1.23.4.5"), *((i, f"copied{far} c@d.org") for i in range(300, 306)), (400, "Li alone")]
    found = spans_of(spark.createDataFrame(rows, DOCS))
    end = 2 + len(far) + 1
    assert found[100] == f"term:0:2,email:{end + 4}:{end + 11}" and found[400] == "term:0:2"
    end = 8 + len(far) + 1
    assert found[200] == f"term:0:8,ip:{end}:{end + 8},term:{end + 9}:{end + 17}"
    assert "term" not in found[1] + found[300] + found[1500] and "ip:" in found[1] and "email:" in found[300]


def test_pii_generalises_to_broader_terms(spark):
    rows = [*((i, f"Bluebird and Marmalade of x{i}@b.com") for i in range(30)), (40, "Bluebird alone, marmalade alone"), (41, "a bluebird"), (42, "marmalade"), *((i, f"plain text and of {i}") for i in range(50, 900))]
    broader = spark.createDataFrame([("bluebird", "a project"), ("marmalade", "Bluebird"), ("plain", "never")], "term string, broader string")
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, DOCS), broader=broader).collect()}
    # a broader term that discloses something itself isn't taken
    assert clean[40] == "a project alone, [TERM] alone" and clean[3] == "a project and [TERM] of [EMAIL]" and clean[60] == "plain text and of 60"


def planted(seed=9, n=600):
    """Documents in which a project's name gives a mail domain away, a nickname one person, and a word all phones."""
    r = random.Random(seed)
    common = [f"common{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs = []
    for i in range(n):
        w = [r.choice(common) for _ in range(r.randint(5, 60))]
        if i % 20 == 0:
            w += ["Bluebird", f"user{i}@bluebird.org"]
        if i % 25 == 1:
            w += ["hotline", f"+49 30 {1000000 + i}"]
        if i % 150 == 2:
            w += ["Quicksilver", "11.22.33.44"]
        if i % 97 == 3:
            w += ["4111 1111 1111 1111", *[f"x{j}@many.net" for j in range(40)]]
        r.shuffle(w)
        docs.append((i, " ".join(w)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "bluebird without any address"), (n + 3, "same a@same.org"), (n + 3, "same a@same.org")]


@pytest.mark.parametrize(("alpha", "support"), [(0.9, 3), (0.6, 2)])
def test_pii_terms_equal_a_plain_loop(spark, alpha, support):
    docs = planted()
    want = disclosing_terms([t for _, t in docs], alpha, support)
    assert {"bluebird", "hotline", "quicksilver"} <= set(want) and not any(w.startswith("common") for w in want) or alpha < 0.9
    found = pii.find_pii(spark.createDataFrame(docs, DOCS), alpha=alpha, support=support).select("doc_id", pii.span_list(F.col("all")).alias("s"), F.exists("all", lambda x: x["certain"]).alias("c")).collect()
    by_id = dict(docs)
    for row in found:
        terms = [tuple(map(int, x.split(":")[1:])) for x in row.s.split(",") if x.startswith("term")]
        assert terms == term_spans(by_id[row.doc_id], want)
        assert row.c == any(want[(by_id[row.doc_id])[a:b].lower()] for a, b in terms)
    # every planted mention is found, also the one away from any address
    mentions = [i for i, t in docs if t and any(w in t.lower() for w in ("bluebird ", "hotline", "quicksilver"))]
    assert {r.doc_id for r in found if "term" in r.s} >= set(mentions)


def test_pii_query_terms_equal_a_plain_loop(spark):
    docs = rows_of_sql("SELECT doc_id, text FROM documents", SMALL, ["doc_id", "text"])
    want = disclosing_terms([t for _, t in docs], pii.ALPHA, pii.MIN_SUPPORT)
    by_id, n = dict(docs), 0
    for row in QUERIES["op8_pii"](spark, SMALL).collect():
        terms = [tuple(map(int, x.split(":")[1:])) for x in row.spans.split(",") if x.startswith("term")]
        assert terms == term_spans(by_id[row.doc_id], want)
        n += len(terms)
    assert n == 0  # the table's identifiers are drawn at random, so no word of it gives one away


def test_pii_term_is_marked_away_from_the_identifier(spark):
    rows = [*((i, f"the marmalade of alpha@b.com {i}") for i in range(9)), (20, "only marmalade"), *((i, "the plain text of all") for i in range(30, 400))]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    assert clean[0] == "the [TERM] of [EMAIL] 0" and clean[20] == "only [TERM]" and clean[30] == "the plain text of all"


def pii_spans(row):
    return row.s


# --- mixing ---------------------------------------------------------------------------------------


def raked(cells, targets, sweeps=200):
    w = {c: t for c, t in cells.items() if t}
    for _ in range(sweeps):
        for d, target in enumerate(targets):
            have = {}
            for c, x in w.items():
                have[c[d]] = have.get(c[d], 0) + x
            w = {c: x * target[c[d]] / have[c[d]] for c, x in w.items()}
    return w


def test_mixing_meets_marginals(spark):
    r = random.Random(7)
    rows = [(i, r.choice("aab"), r.choice(["en", "en", "de", None]), r.choice("pq"), float(r.randint(0, 50))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens double").withColumn("cell", F.lit(1))
    out = mixing.mix(df, share=0.3).collect()
    assert len(out) == 600
    cells, dims = {}, ({}, {}, {})
    for _, *key, tokens in rows:
        key = tuple(k or mixing.NONE for k in key)
        cells[key] = cells.get(key, 0) + tokens
        for d, k in zip(dims, key, strict=True):
            d[k] = d.get(k, 0) + tokens
    targets = []
    for d in dims:
        s = sum(x**0.7 for x in d.values())
        targets.append({k: x**0.7 / s for k, x in d.items()})
    want = raked(cells, targets)
    for x in out:
        key = tuple(k or mixing.NONE for k in (x.source, x.lang, x.topic))
        assert abs(x.mixed.w - want[key]) < 1e-5
    expected = sum(x.tokens * x.mixed.probability for x in out)
    assert abs(expected - 0.3 * sum(x.tokens for x in out)) < 1e-3
    assert all(x.mixed.off <= mixing.TOLERANCE for x in out)
    assert [x.mixed.sampled for x in sorted(out, key=lambda x: x.doc_id)] == [x.mixed.sampled for x in sorted(mixing.mix(df, share=0.3).collect(), key=lambda x: x.doc_id)]
    assert mixing.mix(df.limit(0), share=0.3).count() == 0


def test_mixing_of_targets_that_contradict(spark):
    rows = [(1, "a", "en", "p", 10.0, 1), (2, "b", "de", "p", 10.0, 2), (3, "b", "de", "q", 0.0, 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens double, Mixed int")
    targets = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double"), "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, share double")}
    out = mixing.mix(df, 0.5, targets=targets)
    assert out.columns == ["doc_id", "source", "lang", "topic", "tokens", "mixed"]
    assert all(x.mixed.off > 0.1 for x in out.collect()) and out.count() == 3
    with pytest.raises(ValueError, match="contradict"):
        mixing.mix(df, 0.5, targets=targets, strict=True)
    slow = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double")}
    assert all(x.mixed.off <= mixing.TOLERANCE for x in mixing.mix(df, 0.5, targets=slow, strict=True).collect())


def test_mixing_query_equals_brute_force(spark):
    docs = rows_of_sql("SELECT doc_id, lang, source, text FROM documents", SMALL, ["doc_id", "lang", "source", "text"])
    want = mixed_documents(docs, 0.5)
    got = {r.doc_id: (r.n_tokens, r.probability, r.sampled) for r in QUERIES["op10_mixing"](spark, SMALL).collect()}
    assert set(got) == set(want)
    for i, (n, p, s) in want.items():
        assert got[i][0] == n and abs(got[i][1] - p) < 1e-4 and (got[i][2] == s or abs(got[i][1] - uniform(i)) < 1e-4)


# --- classifiers ----------------------------------------------------------------------------------


def labelled(spark):
    r = random.Random(11)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit"]
    docs, labels = [], []
    for i in range(400):
        text = " ".join(r.choice(words) for _ in range(60))
        bad = i % 4 == 0
        docs.append((i, text.replace("dolor", "you idiot") if bad else text))
        labels.append((i, int(not bad), int(bad)))
    docs += [(1000, None), (1001, ""), (1002, "you idiot"), (1003, "lorem " * 50_000)]
    return spark.createDataFrame(docs, DOCS).withColumn("score_by", F.lit(1)), spark.createDataFrame([*labels, (7, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    held = F.col("doc_id") % 3 == 1
    model = toxicity.fit(docs, labels, ~held)
    got = model.score(docs).join(labels, "doc_id").where(held).select("score", "toxic").collect()
    assert all((r.score >= 0.7) == bool(r.toxic) for r in got) and len(got) > 100
    edge = {r.doc_id: r.score for r in model.score(docs).where("doc_id >= 1000").collect()}
    assert edge[1000] == edge[1001] and edge[1002] > edge[1003] and all(0 <= s <= 1 for s in edge.values())
    clashing(model, docs)
    constant = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert constant.score(docs.limit(1)).first().score == 0.0
    assert toxicity.fit(docs.limit(0), labels, F.lit(True)).score(docs.limit(1)).first().score == 0.0
    twice = toxicity.fit(docs, labels.unionByName(labels), ~held)
    assert all((r.score >= 0.7) == bool(r.toxic) for r in twice.score(docs).join(labels, "doc_id").where(held).select("score", "toxic").collect())


def clashing(model, docs):
    """Scores of docs beside columns whose names the models use themselves."""
    names = ("features", "prediction", "rawPrediction", "probability", "differences", "x", "row", "calibrated", "SCORE")
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = model.score(wide)
    assert out.columns == [*docs.columns, *names[:-1], "score"] and out.where("row = 6 AND x = 5").count() == docs.count()
    assert model.score(docs.limit(0)).count() == 0


def held_out_of(name, spark, sf_dir, label):
    truth = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).alias("truth"))
    return QUERIES[name](spark, sf_dir).join(truth, "doc_id").where("held_out AND truth IS NOT NULL").select("predicted", "truth").collect()


def test_toxicity_of_held_out_documents(spark):
    rows = held_out_of("op3_toxicity", spark, LARGER, "toxic")
    hit, false = sum(r.predicted and r.truth for r in rows), sum(r.predicted and not r.truth for r in rows)
    assert hit >= 0.7 * sum(r.truth for r in rows) and false <= 0.02 * len(rows)


def test_quality_of_held_out_documents(spark):
    rows = held_out_of("op5_compression_quality", spark, LARGER, "quality")
    good = [r.predicted for r in rows if r.truth]
    bad = [r.predicted for r in rows if not r.truth]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.55 * len(bad)


def test_quality_lives_by_its_dictionaries(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = compression_quality.fit(docs, labels, ~held)
    rows = docs.join(labels, "doc_id").where(held & F.col("quality").isNotNull()).select("text", "quality")

    def bad_kept(good, bad):
        x = rows.select("quality", compression_quality.differences(F.col("text"), good, bad).alias("x"))
        return {r.quality: r.n for r in calibrated(x, model.steps).where("calibrated >= 0.3").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}

    whole, same, swapped = bad_kept(model.good, model.bad), bad_kept(model.good, model.good), bad_kept(model.bad, model.good)
    n = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert whole[1] >= 0.95 * n[1] and whole.get(0, 0) < n[0]
    assert same.get(0, 0) / n[0] == same.get(1, 0) / n[1]  # without a difference nothing is told apart
    assert swapped.get(1, 0) < 0.5 * n[1]


def test_quality_dictionaries_read_whole_texts(spark):
    mark = "".join(random.Random(4).choice("qxzvjk ") for _ in range(900))
    docs = [(i, "lorem ipsum dolor sit amet " * 900 + (mark if i % 2 else "plain tail " * 80) * 4) for i in range(40)]
    sample = spark.createDataFrame([(i, t) for i, t in docs if i % 2], DOCS)
    pieces = compression_quality._pieces(sample, 10_000)
    assert sum(map(len, pieces)) == sum(len(t) for i, t in docs if i % 2) and sum(mark[:50].encode() in p for p in pieces) >= 20
    assert 20 < len(compression_quality._pieces(sample, 60)) < 110


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", " ", "### ")).otherwise(F.col("text")))
    held = F.col("doc_id") % 5 == 0
    model = compression_quality.fit(docs, labels, ~held)
    got = model.score(docs).join(labels, "doc_id").where(held).select("score", "quality").collect()
    assert all((r.score >= 0.3) == bool(r.quality) for r in got) and len(got) > 60
    edge = {r.doc_id: r.score for r in model.score(docs).where("doc_id >= 1000").collect()}
    assert edge[1000] == edge[1001] and all(0 <= s <= 1 for s in edge.values())
    clashing(model, docs)
    assert compression_quality.fit(docs, labels.where("quality = 1"), F.lit(True)).score(docs.limit(1)).first().score == 1.0
    assert compression_quality.fit(docs.limit(0), labels, F.lit(True)).score(docs.limit(1)).first().score == 0.0


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.7), ("op5_compression_quality", "quality", 0.3)])
def test_classifier_queries(spark, name, label, least):
    rows = QUERIES[name](spark, SMALL)
    assert rows.count() == 200 and rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert rows.where((F.col("score") >= least) != (F.col("predicted") == 1)).count() == 0


# --- WARC -----------------------------------------------------------------------------------------


def test_revisits(spark):
    rows = [
        (1, "http://a/x", 1, True, "d1", {"ETag": "a", "Server": "s"}), (2, "http://a/x", 5, False, None, {"etag": "W/a", "server": "t", "Date": "5"}), (3, "http://A:80/x/", 6, False, None, {"etag": "b"}),
        (4, None, 6, False, None, {"etag": "b"}), (5, "http://a/x", None, False, None, None), (6, "http://b", 3, False, None, None), (7, "https://a/x#top", 9, False, "d1", None),
        (8, "http://a/x", 10, False, None, None), (8, "http://a/x", 10, False, None, None), (9, "http://a/x", 1_000_000, False, "d1", None),
    ]
    df = spark.createDataFrame(rows, warc_revisits.RECORD).withColumn("verdict", F.lit(1))
    got = sorted((r.record_id, r.response_id, r.verdict, r.digest) for r in warc_revisits.resolve_revisits(df, slices=4).collect())
    none = "no earlier response"
    assert got == [(2, 1, "resolved", "d1"), (3, 1, "validator mismatch", None), (4, None, none, None), (5, None, none, None), (6, None, none, None), (7, 1, "resolved", "d1"), (8, 1, "no validator", None), (8, 1, "no validator", None), (9, 1, "resolved", "d1")]
    headers = {r.record_id: r.headers for r in warc_revisits.resolve_revisits(df).collect()}
    assert headers[2] == {"etag": "W/a", "server": "s", "date": "5"}
    assert warc_revisits.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b"), [("http://Www.A.com:80/x/?utm_source=f&b=2&a=1#t", "a.com/x?a=1&b=2"), ("https://a.com", "a.com"), ("a.com/?ref=x", "a.com")])
def test_canonical_url(spark, a, b):
    assert spark.range(1).select(warc_revisits.canonical_url(F.lit(a)).alias("u")).first().u == b


def test_canonical_url_keeps_what_is_asked_for(spark):
    u = lambda **k: spark.range(1).select(warc_revisits.canonical_url(F.lit("HTTPS://www.A.com/x/"), **k).alias("u")).first().u
    assert (u(), u(scheme=True), u(www=True), u(scheme=True, www=True)) == ("a.com/x", "https://a.com/x", "www.a.com/x", "https://www.a.com/x")


def test_revisits_equal_a_plain_loop_with_a_wrong_time(spark):
    r = random.Random(3)
    rows = [(i, f"http://h{r.randint(0, 3)}/", r.choice([*range(50), 10**15]), r.random() < 0.4, f"d{r.randint(0, 2)}", {"etag": f"e{r.randint(0, 2)}"}) for i in range(300)]
    got = {x.record_id: (x.response_id, x.verdict) for x in warc_revisits.resolve_revisits(spark.createDataFrame(rows, warc_revisits.RECORD), slices=8).collect()}
    for i, u, at, full, _, h in rows:
        if not full:
            before = [(x[2], x[0], x[5]) for x in rows if x[3] and x[1] == u and (x[2], x[0]) < (at, i)]
            best = max(before, default=None, key=lambda x: x[:2])
            assert got[i] == ((best[1], "resolved" if best[2] == h else "validator mismatch") if best else (None, "no earlier response"))


def test_revisit_query_has_every_verdict(spark):
    got = {r.verdict for r in QUERIES["op6_warc_revisits"](spark, SMALL).select("verdict").distinct().collect()}
    assert got == {"resolved", "validator mismatch", "no validator", "no earlier response"}
