"""Readers, writers and small functions that no query over the tables can show."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from vellum.functions import text as T
from vellum.operators import metrics, redact, retrieve, rules, scoring
from vellum.plans import registry
from vellum.sources import files

from .oracle import SMALL
from .test_operators import plainly_redacted
from .test_plain import documents, matched, sentences
from .test_versions import brute


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert sorted((r.a, r.b) for r in files.read_jsonl(spark, f"{tmp_path}/a.jsonl", "a int, b string").collect()) == [(1, None), (2, "x")]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nbroken\n   \n')
    loose = files.read_jsonl(spark, f"{tmp_path}/b.jsonl", "a int", strict=False)
    assert sorted((r.row and r.row.a or 0, r.line) for r in loose.collect()) == [(0, "broken"), (1, '{"a": 1}')]
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        files.read_jsonl(spark, f"{tmp_path}/b.jsonl", "a int").collect()


def test_csv_for_spreadsheets(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi", you', 1)], "x string, y string, z int")
    files.export_csv(df, f"{tmp_path}/out", ["y", "x"], one_file=True)
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_bytes().decode("utf-8") == '﻿y,x\n"say ""hi"", you",a\n'


def test_reports_are_written(spark, tmp_path):
    df = spark.createDataFrame([("m", 1.5)], "name string, a double").coalesce(1)
    scoring.write_report(df, f"{tmp_path}/j")
    scoring.write_report(df, f"{tmp_path}/c", "csv")
    (j,), (c,) = (tmp_path / "j").glob("part-*"), (tmp_path / "c").glob("part-*")
    assert json.loads(j.read_text()) == {"name": "m", "a": 1.5} and c.read_text() == "a,name\n1.5,m\n"


def test_previews(spark):
    row = spark.range(1).select(T.preview(F.lit("  abcdef "), 6).alias("a"), T.preview(F.lit("abcdefg"), 6).alias("b"), T.preview(F.lit("abcdefg"), 3, "").alias("c"), T.preview(F.lit(None).cast("string")).alias("d")).first()
    assert tuple(row) == ("abcdef", "abcdef...(truncated)", "abc", "")


def test_listing_filters(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", None)], "id int, contract_type string, enabled boolean")
    ids = lambda *a: sorted(r.id for r in rules.list_rules(df, *a).collect())
    assert ids() == [1, 2, 3] and ids("a") == [1, 2] and ids(None, False) == [2] and ids("b", True) == []


def test_weak_hits_go(spark):
    hits = spark.createDataFrame([(1, 0.02), (2, 0.019999), (3, -1.0)], "id int, score double")
    assert [r.id for r in retrieve.strong(hits).collect()] == [1]


def test_stability_of_answers_equals_a_plain_count(spark):
    r = random.Random(2)
    canon = lambda x: json.dumps(x, sort_keys=True)
    runs = []
    for case in range(6):
        for _ in range(5):
            items = [{k: r.choice(["a", "b"]) for k in r.sample(["change_type", "old_quote", "new_quote", "risk_level"], r.randint(1, 4))} for _ in range(r.randint(0, 2))]
            answer = {"success": r.choice([True, False]), "enhanced": items}
            if r.random() < 0.3:
                answer = dict(reversed(list(answer.items())))
            runs.append((case, answer))

    def structure(a):
        e = a["enhanced"]
        return canon([list(a), a["success"], len(e), [sorted(x) for x in e], [x.get("change_type") for x in e], [x.get("risk_level") for x in e]])

    quotes = lambda a: canon(sorted([x.get(k, "") for k in ("change_type", "old_quote", "new_quote")] for x in a["enhanced"]))
    rate = lambda case, f: Counter(f(a) for c, a in runs if c == case).most_common(1)[0][1] / 5
    df = spark.createDataFrame([(c, json.dumps(a, indent=r.choice([None, 1]))) for c, a in runs], "case_id int, answer string")
    got = {x.case_id: (x.exact_rate, x.structure_rate, x.quotes_rate) for x in metrics.answer_stability(df, "case_id", "answer").collect()}
    assert got == {c: (rate(c, canon), rate(c, structure), rate(c, quotes)) for c in range(6)}


def test_differences_are_told_with_placeholders(spark):
    docs = documents()
    got = {(r.pair_id, r.diff_index): r.content for r in registry.QUERIES["redacted_differences"](spark, SMALL).collect()}
    want, put_away = {}, 0

    def hidden(text, mappings):
        for placeholder, original, _ in sorted(mappings, key=lambda m: -len(m[1])):
            text = text.replace(original, placeholder)
        return text

    for i, old_id in brute(docs).items():
        old, new = sentences(docs[old_id]), sentences(docs[i])
        maps = [plainly_redacted(docs[k], redact.PATTERNS_LATIN)[1] for k in (old_id, i)]
        for n, (kind, j, k) in enumerate(matched(old, new)):
            a, b = ("" if j is None else hidden(old[j], maps[0])), ("" if k is None else hidden(new[k], maps[1]))
            if kind == "modified" and old[j] == new[k]:
                continue
            want[i, n] = {"modified": f"修改内容：{a} → {b}", "added": f"新增内容：{b}", "deleted": f"删除内容：{a}"}[kind]
            put_away += a + b != ("" if j is None else old[j]) + ("" if k is None else new[k])
    assert got == want and len(want) > 20
    rows = spark.createDataFrame([(1, 0, "modified", "call +1 (555) 123-4567", "mail a@b.com or aa@b.com")], "pair_id int, diff_index int, change_type string, old_text string, new_text string")
    side = lambda t: redact.redact(spark.createDataFrame([(1, t)], "pair_id int, text string")).select("pair_id", "mappings")
    told = redact.told_differences(rows, side("call +1 (555) 123-4567"), side("mail a@b.com or aa@b.com")).first().content
    assert "@" not in told and "555" not in told and told.startswith("修改内容：call ")
