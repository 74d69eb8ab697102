"""Line dedup, collocations and alignment of tokenizers."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from vellum.llm import alignment, collocations, common, line_dedup
from vellum.llm.queries import ORACLES, QUERIES

from ..oracle import SMALL, rows_of_sql, same
from . import brute
from .brute import lines_left, sha

DOCS = "doc_id long, text string"

# --- lines ----------------------------------------------------------------------------------------


def test_line_dedup_equals_sql(spark):
    same(QUERIES["op11_line_dedup"](spark, SMALL), ORACLES["op11_line_dedup"], SMALL)


LINES = ["A shared line", "  a SHARED line\t", "a shared line.", "ÄPFEL und Birnen", "äPFEL und birnen", "short", "", "\r", "another line here", "x" * 5_000, "ten chars!", "nine char"]


def line_docs():
    r = random.Random(3)
    docs = [(i, "\n".join(r.choice(LINES) for _ in range(r.randint(0, 12)))) for i in range(60)]
    return [*docs, (60, None), (61, ""), (62, "\n"), (63, "only here, once\n" * 400), (7, "another line here"), (7, None), (None, "ten chars!\nmine alone, no id"), (None, "mine alone, no id\nTEN CHARS!")]


@pytest.mark.parametrize("min_docs", [2, 5])
@pytest.mark.parametrize("bytes", [common.BROADCAST_BYTES, 0])
def test_line_dedup_equals_brute_force(spark, monkeypatch, min_docs, bytes):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bytes)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = line_docs()
    df = spark.createDataFrame(rows, DOCS).withColumn("places", F.lit("x")).withColumn("File", F.lit(1)).withColumn("row", F.lit(2))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    made = line_dedup.dedup_lines(df, min_docs=min_docs).select("row.doc_id", "n_lines", F.size("places"), F.sha2("kept", 256))
    want = [(i, n, gone, sha(left.encode())) for i, n, gone, left in lines_left(rows, min_docs, 10)]
    assert sorted(map(tuple, made.collect()), key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 100
    out = line_dedup.drop_repeated_lines(df, min_docs=min_docs)
    assert out.columns == df.columns and out.where("text IS NULL").count() == 2
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0

# --- alignment of tokenizers ----------------------------------------------------------------------

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
HF = Tokenizer.from_file(PATHS[0])
HF.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
PARTS = ["the ", "Straße", " naïve", "  ", "\n", "\t", "12345", "don't", "😀", "▁", "<|endoftext|>", "<s>", "<0x41>", "\0", "漢字かな", "aaaaaaaa", ".,;", " ", "é", "tokenizers ", "\r\n"]


def test_side_a_equals_the_tokenizer_file():
    side, r = alignment.SideA(open(PATHS[0], "rb").read(), public_tokenizers.PATTERN), random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(1, 30))) for _ in range(400)] + ["a" * 20_000, " \n" * 20_000]
    assert [x.tolist() for x in side.encode(texts)] == [e.ids for e in HF.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_union_find_of_random_graphs():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 30)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 40))]
        up = list(range(n))
        for _ in range(n):
            for u, v in edges:
                up[u] = up[v] = min(up[u], up[v])
        got = alignment.union_find(np.array([u for u, _ in edges], int), np.array([v for _, v in edges], int), n)
        assert got.tolist() == up


@pytest.mark.parametrize("bytes", [common.BROADCAST_BYTES, 0])
def test_alignment_equals_brute_force(spark, monkeypatch, bytes):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bytes)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    r = random.Random(4)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randint(0, 25)))) for i in range(150)]
    rows += [(3, "the the the"), (3, "the the the"), (None, "no id"), (None, None), (9, ""), (10, "word " * 3_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("pairs", F.lit(1)).withColumn("at", F.lit("x"))
    key = lambda x: tuple((v is None, v) for v in x)
    want = [(*x[:7], sha(x[7].encode()) if x[7] else "") for x in brute.plain_alignment(rows, HF, SP)]
    got = alignment.alignment(df, PATHS[0], public_tokenizers.PATTERN, PATHS[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(x[3] > 0 for x in want) > 60 and any(x[1] == 0 and i < 150 for i, x in enumerate(want))
    assert alignment.alignment(df.limit(0), PATHS[0], public_tokenizers.PATTERN, PATHS[1]).count() == 0


def test_alignment_query(spark):
    docs = rows_of_sql("SELECT doc_id, text FROM documents", SMALL, ["doc_id", "text"])
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_alignment"](spark, SMALL).collect()}
    assert got == {x[0]: (*x[:7], sha(x[7].encode()) if x[7] else "") for x in brute.plain_alignment(docs, HF, SP)}

# --- collocations ---------------------------------------------------------------------------------


def phrase_docs():
    r = random.Random(6)
    words = ["new", "York", "city", "of", "the", "a", "São", "x", "12", "naïve word", "\x1c", "🙂"]
    docs = [(i, "".join(r.choice(words) + r.choice([" ", " ", " ", " ", " ", "  ", "\t", ". ", "\n", ".."]) for _ in range(r.randint(0, 160))), r.choice(["en", "de", None])) for i in range(150)]
    return [*docs, (1, None, "en"), (None, "new york " * 300, "en"), (None, "NEW YORK city.", None), (5, " . ,;", "fr"), (6, "rare " * 2_000 + "the end", "und")]


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 500, "WORDS": 4, "MINED": 8, "SHARES": 64, "COUNTERS": 3}])
@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_brute_force(spark, monkeypatch, longest, limits):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0 if limits else common.BROADCAST_BYTES)
    monkeypatch.setattr(common, "HOT_KEYS", 5 if limits else common.HOT_KEYS)
    for k, v in limits.items():
        monkeypatch.setattr(collocations, k, v)
    rows = phrase_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("phrase", F.lit(1)).withColumn("part", F.lit(2))
    want = brute.phrases([(lang, text) for _, text, lang in rows], longest, 10, 25)
    assert sorted(map(tuple, collocations.collocations(df, longest=longest, top=25).collect())) == sorted(want)
    assert len(want) > 50 and collocations.collocations(df.limit(0)).count() == 0


def test_collocations_query(spark):
    docs = rows_of_sql("SELECT lang, text FROM documents", SMALL, ["lang", "text"])
    got = sorted(map(tuple, QUERIES["op12_collocations"](spark, SMALL).collect()))
    assert got == sorted(brute.phrases(docs, 3, 10, 2000)) and len(got) > 100


def test_scores_of_large_counts_are_exact(spark, tmp_path):
    a, x, y = 3_333_333_333_333_333, 4_000_000_000_000_007, 5_123_456_789_012_345
    found = spark.createDataFrame([("en", "x y", 2, a)], "lang string, phrase string, size int, a long")
    words = spark.createDataFrame([("en", "x", x), ("en", "y", y)], "lang string, word string, f long")
    row = collocations.scored(found, words, f"file://{tmp_path}").first()
    assert (row.score, row.l, row.r) == (1_000_000 * a * a // (x * y), x, y)
