"""Operators on small Chinese fixtures of our own, against plain Python where rows can't be read off."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from vellum.functions import labels, text as T
from vellum.plans import streams
from vellum.operators import audit, diff, locate, mine, redact, retrieve, rules, segment, splice, tables
from vellum.sources import files
from vellum.streaming import sessions

CONTRACT = "采购合同\n\n第一条 付款\n甲方应当在三十日内支付货款；乙方开具发票。\n1. 逾期付款按日计算违约金\n（2）双方友好协商\n第二条 保密\n双方对合同内容保密！"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_paragraph_offsets_slice_back(spark):
    df = spark.createDataFrame([(1, CONTRACT), (2, ""), (3, None)], "doc_id long, text string")
    rows = segment.paragraphs(df).collect()
    full = "\n".join(r.text for r in rows)
    assert all(full[r.char_offset_start : r.char_offset_end] == r.text for r in rows) and {r.doc_id for r in rows} == {1}
    assert [(r.paragraph_type, r.paragraph_level) for r in rows[:4]] == [("heading1", 1), ("heading2", 2), ("body", 0), ("heading3", 3)]
    assert [r.is_key_clause for r in rows][:3] == [False, True, False]
    sents = segment.sentences(segment.paragraphs(df)).collect()
    assert all(full[s.char_offset_start : s.char_offset_end] == s.text for s in sents)


def test_clauses_carry_titles(spark):
    got = [(r.clause_id, r.title, r.text) for r in segment.clauses(spark.createDataFrame([(1, CONTRACT)], "doc_id long, text string")).orderBy("order").collect()]
    assert got[0] == ("s-0001", "全文", "采购合同") and got[1] == ("s-0002", "第一条", "付款")
    assert ("s-0005", "第一条 1", "逾期付款按日计算违约金") in got and got[-1][1] == "第二条"


def test_sections_number_repeated_titles(spark):
    df = spark.createDataFrame([(1, "前言\n第一条 付款\na\n第二条 付款\nb")], "doc_id long, text string")
    assert [(r.section_key, r.text) for r in segment.sections(df).orderBy("position").collect()] == [("__preamble__", "前言"), ("付款", "第一条 付款\na"), ("付款#2", "第二条 付款\nb")]


def test_redaction_round_trip(spark):
    text = "星河科技有限公司 电话13800138000，又13800138000，邮箱a.b@c.cn，联系人：李四，金额100元，2024年1月1日"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in redact.restored(redact.redact(df, patterns=redact.PATTERNS_ZH, person=redact.PERSON_ZH)).collect()}
    r = rows[1]
    assert "13800138000" not in r.sanitized_text and r.sanitized_text.count("电话A") == 2 and "100元" in r.sanitized_text and "2024年1月1日" in r.sanitized_text
    assert {m.type for m in r.mappings} == {"company", "mobile", "email", "person"} and r.restored_text == text
    assert rows[2].mappings == [] and rows[3].sanitized_text == ""
    ns = spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 53, 702, 703)], "n long")
    assert [r.x for r in ns.select(redact.letters(F.col("n")).alias("x")).collect()] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def plainly_redacted(text, patterns, person=None):
    """The same by Python's engine, pattern after pattern."""
    import re

    counts, mappings = {}, []

    def named(kind, label, original):
        for m in mappings:
            if m[1:] == (original, kind):
                return m[0]
        counts[label] = counts.get(label, 0) + 1
        n, tail = counts[label], ""
        while n:
            n, r = divmod(n - 1, 26)
            tail = chr(65 + r) + tail
        mappings.append((label + tail, original, kind))
        return label + tail

    for kind, label, pattern in patterns:
        text = re.sub(pattern, lambda m, kind=kind, label=label: named(kind, label, m[0]), text)
    if person:
        text = re.sub(person, lambda m: m[1] + named("person", "人员", m[2]), text)
    return text, mappings


@pytest.mark.parametrize(("patterns", "person"), [(redact.PATTERNS_LATIN, None), (redact.PATTERNS_ZH, redact.PERSON_ZH)])
def test_redaction_equals_a_plain_loop(spark, patterns, person):
    import random

    r = random.Random(5)
    parts = ["a@b.co ", "x.y@z.org,", "+1 (555) 123-4567", "4111111111111111", "10.0.0.1", " word ", "星河科技有限公司", "13800138000", "010-12345678", "联系人：李四", "代表王五", "地址：北京市海淀区一号", "91110000MA01ABCD12", "6222 0000 1111 2222", "开户行：工商银行", "\n", "$1 \\"]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(150)] + [(900, "a@b.co " + " ".join(f"u{i}@v.org" for i in range(60)))]
    rows = redact.redact(spark.createDataFrame(docs, "doc_id long, text string"), patterns=patterns, person=person).collect()
    for row in rows:
        text, mappings = plainly_redacted(row.text, patterns, person)
        assert (row.sanitized_text, [(m.placeholder, m.original, m.type) for m in row.mappings]) == (text, mappings)


def test_sentence_diff_is_a_partition(spark):
    old, new = ["甲方付款", "乙方交货", "全部作废"], ["乙方交货了", "甲方付款", "新增一条"]
    df = spark.createDataFrame([(1, old, new), (2, [], None), (3, ["abc"], ["abc"])], "pair_id long, old_sentences array<string>, new_sentences array<string>")
    rows = diff.sentence_diff(df).orderBy("pair_id", "diff_index").collect()
    first = [(r.change_type, r.old_index, r.new_index) for r in rows if r.pair_id == 1]
    assert first == [("modified", 1, 0), ("modified", 0, 1), ("added", None, 2), ("deleted", 2, None)]
    assert [(r.change_type, r.similarity) for r in rows if r.pair_id == 3] == [("modified", 1.0)]
    assert diff.summarize(diff.sentence_diff(df), "pair_id").where("pair_id = 1").first().total == 4


def test_greedy_match_equals_plain_loop(spark):
    import random

    r = random.Random(1)
    # characters that share a bit of the bitmap are told apart too
    sides = [[["".join(r.choice(["a", "b", "c", "d", "e", chr(97 + 256), chr(98 + 512), "字"]) for _ in range(r.randint(0, 5))) for _ in range(r.randint(0, 9))] for _ in range(2)] for _ in range(80)]
    df = spark.createDataFrame([(i, old, new) for i, (old, new) in enumerate(sides)], "pair_id int, old_sentences array<string>, new_sentences array<string>")
    got = {}
    for x in diff.sentence_diff(df).orderBy("pair_id", "diff_index").collect():
        got.setdefault(x.pair_id, []).append((x.change_type, x.old_index, x.new_index))
    for k, (old, new) in enumerate(sides):
        free, want = set(range(len(old))), []
        for i, s in enumerate(new):
            best, at = 0.0, -1
            for j in sorted(free):
                u = set(s) | set(old[j])
                score = len(set(s) & set(old[j])) / len(u) if s and old[j] else 0.0
                if score > best:
                    best, at = score, j
            if best >= 0.6:
                free.remove(at)
                want.append(("modified", at, i))
            else:
                want.append(("added", None, i))
        assert got.get(k, []) == want + [("deleted", j, None) for j in sorted(free)]
    plan = diff.sentence_diff(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_clause_diff(spark):
    old = "第一条 付款\n甲方应当在30日内付款。\n第二条 保密\n双方保密。\n本合同一式两份。"
    new = "第一条 付款\n甲方应在60日内付款。\n本合同一式两份。\n第二条 保密\n双方保密。\n由北京法院管辖。"
    v = lambda t: segment.clauses(spark.createDataFrame([("p", t)], "pair_id string, text string"), "pair_id")
    rows = diff.clause_diff(v(old), v(new)).collect()
    kinds = {(r.change_type, r.review_module, r.is_substantive) for r in rows}
    assert any(r.before.startswith("甲方") and r.after.startswith("甲方") and r.change_type == "changed" and r.is_substantive and r.confidence == 0.82 for r in rows)
    assert any(k[0] == "moved" and not k[2] for k in kinds) and any("管辖" in r.after and r.is_substantive for r in rows)
    assert diff.clause_diff(v(old), v(old)).count() == 0


def test_locate(spark):
    paras = segment.paragraphs(spark.createDataFrame([(1, "甲方应当付款。\n乙方应当交货，并开具发票。")], "doc_id long, text string"))
    ev = spark.createDataFrame([(1, 1, "开具发票"), (1, 2, "乙方须交货并开发票"), (1, 3, "xyz"), (2, 4, "甲方")], "doc_id long, evidence_id long, evidence string")
    got = {r.evidence_id: (r.paragraph_index, r.match_strategy) for r in locate.best_paragraph(ev, paras).collect()}
    assert got == {1: (1, "containment_exact"), 2: (1, "overlap")}
    s = paras.select("doc_id", F.col("paragraph_index").alias("sentence_index"), "text")
    assert {r.evidence_id: (r.sentence_index, r.tier) for r in locate.best_sentence(ev, s).collect()} == {1: (1, "containment"), 2: (1, "similarity")}


@pytest.mark.parametrize(("value", "want"), [("高风险", "high"), (" Mid ", "medium"), ("属于低风险", "low"), ("通过", "pass"), ("??", "pass"), (None, "pass"), ("", "pass")])
def test_final_risk(spark, value, want):
    assert one(spark, labels.final_risk(F.col("v").cast("string")), v=value) == want


@pytest.mark.parametrize(("args", "want"), [(("pass", "", "", "新"), "manual"), (("high", "k", "原文", "无"), "manual"), (("high", "k", "无", "新"), "append"), (("high", "约定不明确", "原文", "新"), "insert"), (("high", "k", "原文", "新"), "replace"), (("low", "k", "未发现明确原文", "新"), "append")])
def test_action_type(spark, args, want):
    assert one(spark, labels.action_type(*[F.col(c) for c in "rkcn"]), **dict(zip("rkcn", args, strict=True))) == want


def test_label_functions(spark):
    assert one(spark, labels.review_module(F.lit("赔偿总额"), F.lit("违约"))) == "赔偿责任上限"
    assert one(spark, labels.review_module(F.lit("赔偿不设上限"), F.lit(None).cast("string"))) == "赔偿责任上限"
    assert one(spark, labels.review_module(F.lit(""), F.lit(""))) == "通用条款"
    assert one(spark, labels.earliest(F.lit("本服务及采购"), ("采购", "服务"), "其他")) == "服务"
    assert one(spark, labels.perspective(F.lit(" 采购方 "))) == "甲方" and one(spark, labels.compare_risk(F.lit("pass"))) == "low"
    assert one(spark, labels.diff_category(F.lit(""), F.lit("金额"), F.lit(None).cast("string"), F.lit("moved"))) == "合同金额"
    assert one(spark, T.mask(F.lit("电话13800138000，a@b.cn"), T.MASKS_ZH)) == "电话[手机号]，[邮箱]"
    assert one(spark, T.char_jaccard(F.lit("ab"), F.lit("bc"))) == pytest.approx(1 / 3) and one(spark, T.char_jaccard(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, T.keywords(F.lit("因为，付款期限。甲，违约金"))) == ["付款期限", "违约金"]
    assert one(spark, T.compared_sentences(F.lit("甲。 乙！\n丙"))) == ["甲。", "乙！", "丙"]


def test_rules(spark):
    cols = "rule_code string, contract_type string, review_module string, risk_name string, check_point string, trigger_condition string, default_risk_level string, suggestion_template string, row_number long"
    rows = [("R1", "通用", "财务", "n", "c", "t", "高", "s", 2), ("R1", "采购", "法务", "n", "c", "t", "高", "s", 3), ("R2", "采购", "法务", " ", "c", "t", "极高", "s", 4), ("R3", "采购", "履约", "n3", "c", "t", "低", "s", 5)]
    df = spark.createDataFrame(rows, cols).withColumn("review_perspective", F.lit(None).cast("string"))
    checked = {(r.rule_code, r.row_number): r.errors for r in rules.check_import(df).collect()}
    assert checked["R1", 2] == [] and checked["R1", 3] == ["rule_code occurs twice"] and len(checked["R2", 4]) == 2
    good = df.where("row_number IN (2, 5)")
    assert [r.rule_code for r in rules.importable(rules.check_import(good, df.where("row_number = 2"))).collect()] == ["R3"]
    assert rules.importable(rules.check_import(df)).count() == 0
    on = df.withColumn("enabled", F.lit(True))
    assert rules.audit_rules(on, "其他").count() == 1 and rules.audit_rules(on, "采购").count() == 4 and rules.snapshot(on.withColumn("contract_type", F.lit("其他")), "其他").count() == 4
    r = spark.createDataFrame([("", "n", 1), ("", "n", 2), ("A", "n", 3), ("A", "m", 4), (None, None, 5), (None, None, 6)], "rule_code string, risk_name string, pos long")
    assert sorted(x.pos for x in rules.dedup(r).collect()) == [1, 3, 5]


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, seq long")
    c = spark.createDataFrame([(2, None, 1), (3, "c", 1)], "k long, v string, seq long")
    assert sorted((r.k, r.v) for r in tables.upsert(t, c, "k", "seq").collect()) == [(1, "a"), (2, None), (3, "c")]
    assert sorted((r.k, r.v) for r in tables.update_filled(t, c.drop("seq"), "k").collect()) == [(1, "a"), (2, "b")]
    assert sorted(r.v for r in tables.replace_children(t, spark.createDataFrame([(2, "x", 0), (2, "y", 0)], t.schema), "k").collect()) == ["a", "x", "y"]


def test_splice_and_spans(spark):
    docs = spark.createDataFrame([(1, "甲方应付款"), (2, "abc"), (3, "abc")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 2, "乙方"), (1, 3, 5, "交货"), (2, 0, 2, "x"), (2, 1, 3, "y")], "doc_id long, start int, end int, replace_text string")
    assert {r.doc_id: r.spliced_text for r in splice.apply_spans(docs, spans, "doc_id").collect()} == {1: "乙方应交货", 2: None, 3: "abc"}


def test_audit(spark):
    items = spark.createDataFrame([(1, "高", "k", "原文", "新", "R1"), (1, "通过", "", "", "", "")], "t long, risk string, key string, content string, replace_text string, rule_code string")
    n = audit.normalize_items(items)
    totals = audit.counts(n, "t")
    assert totals.first().asDict() == {"t": 1, "agreeCount": "1", "highlevelriskCount": "1", "mediumlevelriskCount": "0", "lowlevelriskCount": "0"}
    assert audit.conformance(n, totals, "t").first().issues == ["code_present"]
    assert [r.action_type for r in audit.risk_points(n).collect()] == ["replace"]


def test_mining(spark):
    d = spark.createDataFrame([("p", 1, "d1", "付款条款", "a", "b", True, 0.8), ("p", 2, "d2", "保密条款", "c", "d", True, 0.8), ("p", 3, "d3", "保密条款", "e", "f", False, 0.4)], "pair_id string, n int, diff_id string, review_module string, before string, after string, is_substantive boolean, confidence double")
    w = spark.createDataFrame([("p", "保密条款"), ("p", "其他")], "pair_id string, review_module string")
    assert {r.review_module: r.diff_id for r in mine.best_clause(d, w).collect()} == {"保密条款": "d2", "其他": "d1"}
    t = spark.createDataFrame([("保密条款", "保密风险"), (None, "通用风险")], "review_module string, risk_name string")
    assert {r.diff_id: r.risk_name for r in mine.rules_without_case(d, t).collect()} == {"d1": "通用风险", "d2": "保密风险"}
    tr = spark.createDataFrame([(1, "p", "a", "b"), (2, "p", "", "")], "trace_id long, pair_id string, evidence_before string, evidence_after string")
    assert {r.trace_id: r.source_diff_id for r in mine.unique_match(tr, d).collect()} == {1: "d1", 2: None}


def test_retrieval_small(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieve.vector_topk(q, v, 3, block=2).orderBy("rank").collect()] == [6, 5, 4]
    f = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (2, 1, 0.1)], "query_id long, doc_id long, score double")
    a = spark.createDataFrame([(1, 2)], "query_id long, doc_id long")
    assert sorted((r.query_id, r.doc_id) for r in retrieve.filter_open(f, a).collect()) == [(1, 2), (2, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.TXT").write_bytes("甲方\n乙方".encode("gbk"))
    (tmp_path / "in/b.exe").write_bytes(b"x")
    (tmp_path / "in/c.docx").write_bytes(b"broken")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f'<w:document xmlns:w="{w}"><w:body>{p("标题")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "in/d.docx").write_bytes(buffer.getvalue())
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, f"{tmp_path}/in").collect()}
    assert got["a.TXT"].text == "甲方\n乙方" and got["b.exe"].error == "unsupported kind" and got["c.docx"].error
    assert got["d.docx"].text == f"标题\n{files.TABLE_MARK}\na | b"
    assert one(spark, files.table_rows(F.lit(f"{files.TABLE_MARK}\na | b\nc | d"))) == [["a", "b"], ["c", "d"]]
    (tmp_path / "r.csv").write_text("﻿规则编码,合同类型\nR1,通用\n", encoding="utf-8")
    with pytest.raises(ValueError, match="missing headers"):
        files.read_rules_csv(spark, f"{tmp_path}/r.csv", rules.HEADERS_ZH)
    assert files.read_rules_csv(spark, f"{tmp_path}/r.csv", {"规则编码": "rule_code", "合同类型": "contract_type"}).first().rule_code == "R1"


@pytest.mark.parametrize(("said", "want"), [('```json\n{"a": 1}\n```', 1), ('<think>{"a": 9}</think> so {"a": 2} ok', 2), ('"{\\"a\\": 3}"', 3), ("none", None)])
def test_lenient_json(spark, said, want):
    got = one(spark, files.unwrapped(F.col("v"), "a int"), v=said)
    assert (got and got["a"]) == want


def test_file_session_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "view"), (1, "2024-01-01 00:01:00", "view"), (1, "2024-01-01 00:02:00", "purchase"), (1, "2024-01-01 00:03:00", "view"), (2, "2024-01-01 00:00:00", "view"), (2, "2024-01-01 01:00:00", "view")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, t string, event_type string").select("event_id", "user_id", F.to_timestamp("t").alias("ts"), "event_type", F.lit("{}").alias("props"))
    df.write.parquet(f"{tmp_path}/e")
    changes = sessions.file_sessions(streams.file_events(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")))
    with sessions.keyed_state(spark):
        q = changes.writeStream.format("memory").queryName("file_sessions").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.user_id, r.at.isoformat(), r.session, r.status) for r in spark.sql("SELECT * FROM file_sessions").collect())
    assert [(u, s, st) for u, _, s, st in got] == [(1, 1, "waiting"), (1, 1, "processing"), (1, 1, "done"), (1, 2, "waiting"), (2, 1, "waiting"), (2, 2, "waiting")]


def test_rule_files_have_row_numbers(spark, tmp_path):
    heads = rules.HEADERS_ZH
    (tmp_path / "f").mkdir()
    body = ",".join(heads) + "\n" + "\n".join(f'R{i},t,甲方,m,"risk, with\nbreak",c,g,高,s,e' if i != 2 else "" for i in range(4))
    (tmp_path / "f" / "a.csv").write_bytes(body.encode("gbk"))
    (tmp_path / "f" / "b.csv").write_bytes("\ufeff".encode() + body.replace("R", "S").encode())
    rows = {r.rule_code: (r.row_number, r.risk_name) for r in files.read_rules_csv(spark, str(tmp_path / "f"), heads).collect()}
    assert rows == {f"{x}{i}": (n, "risk, with\nbreak") for x in "RS" for i, n in ((0, 2), (1, 3), (3, 5))}
    (tmp_path / "g.csv").write_text("规则编码,合同类型\na,b\n")
    with pytest.raises(ValueError, match="missing headers"):
        files.read_rules_csv(spark, str(tmp_path / "g.csv"), heads)


def test_case_lines_have_numbers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n  \n{"a": \n[1]\n{"b": 2}')
    got = [(r.line_number, r.row and r.row.a, r.error) for r in files.read_cases(spark, str(tmp_path / "c.jsonl"), "a int").orderBy("line_number").collect()]
    assert got == [(1, 1, None), (4, None, "line 4 is no JSON object"), (5, None, "line 5 is no JSON object"), (6, None, None)]


def test_rules_in_any_shape(spark):
    said = ['[{"a": 1}, {"a": 2}]', '<think>[]</think>{"rules": [{"a": 3}]}', 'so: {"a": 4}', "none", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [r.x and [y.a for y in r.x] for r in df.select("i", files.rules_in(F.col("s"), "struct<a:int>").alias("x")).orderBy("i").collect()]
    assert got == [[1, 2], [3], [4], None, None]


def test_table_block_round_trip(spark):
    df = spark.createDataFrame([([["a", "b"], ["c", ""]],), ([],)], "rows array<array<string>>")
    got = df.select(files.table_block(F.col("rows")).alias("t")).select("t", files.table_rows(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [[["a", "b"], ["c", ""]], None]


def test_rules_from_a_provider(spark):
    def provider(row):
        if row["diff_id"] == 2:
            raise ValueError("no answer")
        return [{"risk_name": row["after"], "level": i} for i in range(row["diff_id"])]

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "diff_id long, after string")
    got = sorted(map(tuple, mine.generated(df, provider, "risk_name string, level int").collect()), key=str)
    assert got == [(1, "a", 0, None), (2, None, None, "ValueError: no answer"), (3, "c", 0, None), (3, "c", 1, None), (3, "c", 2, None)]
